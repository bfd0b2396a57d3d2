"""Repeats and chunks against brute force, and by their invariants."""

import random

import pytest
from pyspark.sql import functions as F

from needlework.operators import chunking, repeats
from needlework.operators.repeats import Options, find_repeats


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "hay_id long, text string")


def tiles():
    data = bytearray(random.Random(21).randbytes(64 * 4096))
    data[40 * 4096 : 41 * 4096] = data[:4096]
    return bytes(data)


CASES = [
    (b"pqrSTUpqrSTUpqr~~~tumtum~~~pqrSTU", Options(3, 16, 2, 8)),
    (b"LINE_OF_A_PATTERN_" * 190, Options(8, 64, 2, 8)),
    (b"<li id=7>entry VALUE</li>" * 70, Options(8, 4096, 2, 16)),
    (tiles()[:60_000] + tiles()[:5000], Options(64, 8192, 2, 8)),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_budgeted_repeats(case):
    data, options = CASES[case]
    found = find_repeats(data, options)
    assert 0 < len(found) <= options.top_k and len({r[4] for r in found}) == len(found)
    for off, length, count, est, sub in found:
        assert data[off : off + length] == sub and data.count(sub) == count >= options.min_count
        assert options.min_len <= length <= min(options.max_len, len(data) // 2)
        assert est == length + len(data) - count * (length - (4 + 2 * (length >= 10) + (length >= 100)))
    assert found == sorted(found, key=lambda r: (r[3], -r[1], -r[2], r[4]))
    assert any(r[1] >= 1024 for r in found) or case != 3


def test_budgeted_repeats_see_past_a_long_passage():
    rnd = random.Random(9)
    line, passage = (bytes(rnd.choices(range(97, 123), k=k)) for k in (60, 1900))
    data = passage + b"".join(line + bytes(rnd.choices(range(128, 256), k=7)) for _ in range(100)) + passage
    found = find_repeats(data, Options())
    assert found[0][2:] == (100, 60 + len(data) - 100 * (60 - 6), line)


def test_budgeted_repeats_miss_no_interval():
    rnd = random.Random(10)
    for _ in range(300):
        data = bytes(rnd.choices(b"abc", k=rnd.randint(8, 60))) * rnd.choice([1, 1, 2, 3, 7])
        options = Options(rnd.choice([2, 4]), rnd.choice([6, 256]), 2, 5)
        top = min(options.max_len, len(data) // 2)
        subs = {data[i : i + k] for k in range(options.min_len, top + 1) for i in range(len(data) - k + 1)}
        est = lambda s: len(s) + len(data) - data.count(s) * (len(s) - (4 + 2 * (len(s) >= 10) + (len(s) >= 100)))
        want = min((est(s) for s in subs if data.count(s) >= 2), default=None)
        found = find_repeats(data, options)
        assert (found[0][3] if found else None) == want, (data, options)


def test_budgeted_repeats_of_little(spark):
    assert find_repeats(b"", Options()) == [] == find_repeats(b"abc", Options()) == find_repeats(bytes(range(200)), Options())
    rows = repeats.repeats(frame(spark, ["abcabcabcabc xy", None, "", "abcabcabcabc xy"]), Options(3, 16, 2, 4)).collect()
    assert {r["hay_id"] for r in rows} == {0, 3} and len({(r["off"], r["len"], r["n"], bytes(r["sub"])) for r in rows}) * 2 == len(rows)


def plain_extended(text, k, stride, options, seeds=False):
    """Pairs of equal windows grown a character at a time; counts by a greedy walk."""
    pairs, rows = [], {}
    if seeds:
        k = min(8, options.min_len)
        pairs = [(a, b) for a in range(0, len(text) - k + 1, 8 * k) for b in [text.find(text[a : a + k], a + 1)] if b >= 0]
    else:
        places = {}
        for a in range(0, len(text) - k + 1, stride):
            places.setdefault(text[a : a + k], []).append(a)
        pairs = [p[:2] for p in places.values() if len(p) > 1]
    for a, b in pairs:
        left = right = 0
        while left < a and text[a - left - 1] == text[b - left - 1]:
            left += 1
        while b + k + right < len(text) and text[a + k + right] == text[b + k + right]:
            right += 1
        length = min(options.max_len, left + k + right)
        for fit in {length} if seeds else {length, min(8, max(5, options.min_len))}:
            sub, n = text[a - left : a - left + fit], 0
            if not options.min_len <= fit <= length:
                continue
            at = text.find(sub)
            while at >= 0:
                n, at = n + 1, text.find(sub, at + fit)
            if n >= options.min_count:
                rows[sub] = (text.find(sub), fit, n, fit + len(text) - n * (fit - 4 - 2 * (fit >= 10) - (fit >= 100)), sub)
    return sorted(rows.values(), key=lambda r: (r[3], -r[1], -r[2], r[4]))[: options.top_k]


def test_extension_equals_the_plain_rule(spark):
    rnd = random.Random(12)
    parts = ["".join(rnd.choices("abcé ", k=rnd.randint(5, 80))) for _ in range(6)]
    texts = ["", "x", "aaaaaaaaaaaaaaaaaaaaaaa", *["".join(rnd.choices(parts, k=rnd.randint(2, 12))) for _ in range(30)]]
    for options in (Options(4, 30, 2, 6), Options(3, 256, 3, 24)):
        got = repeats.extended(frame(spark, [*texts, None]), 8, 4, options).collect()
        assert sorted(map(tuple, got)) == sorted((i, *r) for i, t in enumerate(texts) for r in plain_extended(t, 8, 4, options))
        got = repeats.seeded(frame(spark, texts), options).collect()
        assert sorted(map(tuple, got)) == sorted((i, *r) for i, t in enumerate(texts) for r in plain_extended(t, 0, 0, options, True))


def test_twin_chunks(spark):
    state, table = 0x9E3779B97F4A7C15, []
    for i in range(256):
        state ^= state >> 12
        state ^= state << 25 & 2**64 - 1
        state ^= state >> 27
        state = state * 0x2545F4914F6CDD1D & 2**64 - 1
        table.append((state + i * 0x9E3779B97F4A7C15) & 2**64 - 1)
    assert [int(x) for x in chunking.repeats_gear()] == table
    rnd = random.Random(2)
    passage = bytes(rnd.randrange(256) for _ in range(20_000))
    moved = bytes(rnd.randrange(256) for _ in range(777)) + passage + bytes(rnd.randrange(256) for _ in range(3001)) + passage
    aligned = passage[:8192] + bytes(rnd.randrange(256) for _ in range(4096)) + passage[:8192]
    options = Options(4, 30_000, 2, 4)
    assert repeats.twin_chunks(moved, options)[0] == (777, 20_000, 2, 20_000 + len(moved) - 2 * (20_000 - 7), passage)  # cut where the contents say
    assert repeats.twin_chunks(aligned, options)[0][:3] == (0, 8192, 2)
    assert max(r[1] for r in repeats.twin_chunks(tiles(), Options(64, 8192, 2, 8))) >= 4096
    rows = spark.createDataFrame([(1, bytearray(moved)), (2, bytearray(b"")), (3, None)], "hay_id long, text binary")
    assert [(r["hay_id"], r["off"], r["len"]) for r in repeats.twins(rows, options).orderBy("est_lin").collect()][0] == (1, 777, 20_000)


def test_suffixes_of_several_haystacks():
    rnd = random.Random(3)
    for _ in range(60):
        texts = [bytes(rnd.choices(b"abc"[: rnd.randint(1, 3)], k=rnd.randint(0, 30))) * rnd.choice([1, 2, 5]) for _ in range(rnd.randint(1, 4))]
        order, common, base = [], [], 0
        for t in texts:
            own = sorted(range(len(t)), key=lambda i: t[i:])
            order += [base + i for i in own]
            common += [0 if not j else next((k for k in range(len(t)) if t[i + k : i + k + 1] != t[own[j - 1] + k : own[j - 1] + k + 1]), 0) for j, i in enumerate(own)]
            base += len(t)
        data, ends = repeats.np.frombuffer(b"".join(texts), "u1"), repeats.np.cumsum([len(t) for t in texts])
        got = repeats.suffix_order(data, ends)
        assert got[0].tolist() == order and got[1].tolist() == common
        assert repeats.suffix_order(data, ends, 5)[1].tolist() == [min(5, x) for x in common]


def test_repeats_of_bytes(spark):
    raw = bytes(range(128, 256)) * 6 + b"\xff\xfe" * 9
    rows = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b""))], "hay_id long, text binary")
    got = repeats.repeats(rows).collect()
    assert {r["hay_id"] for r in got} == {1} and [(r["off"], r["len"], r["n"], r["est_lin"], bytes(r["sub"])) for r in got] == find_repeats(raw, Options())


def test_longest_equals_brute_force(spark):
    rnd = random.Random(5)
    texts = ["", "a", "aaaa", "abcabc", "banana" * 4] + ["".join(rnd.choice("abé") for _ in range(rnd.randint(2, 60))) for _ in range(30)]

    def brute(text):
        most = max((k for k in range(1, len(text)) for i in range(len(text) - k + 1) if text.find(text[i : i + k], i + 1) >= 0), default=0)
        return most if most >= 2 else 0

    assert {r["hay_id"]: r["len"] for r in repeats.longest(frame(spark, texts), 2).collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_windows(spark):
    texts = ["abcdefgh" * 5 + "tail", "", "short", None, "é" * 33 + "\n" * 8]
    for k, stride in ((8, 8), (3, 8), (4, 1), (5, 7)):
        got = {tuple(r) for r in repeats.windows(frame(spark, texts), k, stride).collect()}
        assert got == {(i, p, t[p : p + k]) for i, t in enumerate(texts) if t for p in range(0, len(t) - k + 1, stride)}, (k, stride)
    scored = repeats.scored(frame(spark, texts), (8, 4)).collect()
    assert all(r["est_lin"] == r["len"] + len(texts[r["hay_id"]]) - r["n"] * (r["len"] - 4) and texts[r["hay_id"]].count(r["sub"]) == r["n"] for r in scored)


def slow_cuts(data, least, most):
    g, out, begin, h = [int(x) for x in chunking.gear()], [], 0, 0
    for i, b in enumerate(data):
        h = (h << 1) + g[b] & 2**64 - 1
        n = i + 1 - begin
        if n >= least and h & (1 << chunking.BITS) - 1 == 0 or n >= most or i + 1 == len(data):
            out.append(i + 1)
            begin, h = i + 1, 0
    return out


def test_chunks_equal_the_byte_by_byte_rule(spark):
    rnd = random.Random(6)
    data = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 1, 1023, 1024, 40_000, 90_000)] + [b"x" * 50_000, tiles()]
    for d in data:
        assert chunking.cuts(d) == slow_cuts(d, chunking.LEAST, chunking.MOST)
    texts = ["".join(rnd.choice("abcdef é") for _ in range(30_000)), "", None, "tiny"]
    texts += [texts[0], "prefix " + texts[0]]
    parts = chunking.chunks(frame(spark, texts)).cache()
    back = {r["hay_id"]: bytes(r["bytes"]).decode() for r in chunking.assemble(parts).collect()}
    assert back == {i: t for i, t in enumerate(texts) if t}
    assert chunking.offsets(parts).join(parts.withColumnRenamed("off", "own"), ["hay_id", "seq"]).where("off <> own").count() == 0
    got = {r["hay_id"]: bytes(r["bytes"]) for r in chunking.read_chunks(parts, 5000, 12_000).collect()}
    assert got == {i: t.encode()[5000:17_000] for i, t in enumerate(texts) if t and len(t.encode()) > 5000}
    stats = chunking.dedup_stats(parts).first()
    assert stats["raw_bytes"] == sum(len((t or "").encode()) for t in texts) and stats["resident_bytes"] < 0.6 * stats["raw_bytes"]
    assert all(r["n"] >= 2 for r in chunking.twins(parts).collect())
    places = {}
    for i, t in enumerate(texts):
        ends = slow_cuts((t or "").encode(), chunking.LEAST, chunking.MOST)
        for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            places.setdefault((t or "").encode()[a:b], []).append((i, k))
    kept = {bytes(r["chunk"]): (r["chunk_hay"], r["chunk_seq"], r["refs"]) for r in chunking.chunk_table(parts).collect()}
    assert kept == {c: (*min(p), len(p)) for c, p in places.items()}
    objects = {r["hay_id"]: (r["chunks"], r["bytes"]) for r in chunking.object_table(parts).collect()}
    assert objects == {i: (len(slow_cuts(t.encode(), chunking.LEAST, chunking.MOST)), len(t.encode())) for i, t in enumerate(texts) if t}
    whole = chunking.fixed_chunks(frame(spark, texts), 1000).where(F.col("hay_id") == 0).orderBy("seq").collect()
    assert [bytes(r["chunk"]) for r in whole] == [texts[0].encode()[i : i + 1000] for i in range(0, len(texts[0].encode()) - 999, 1000)]
    with pytest.raises(ValueError, match="bytes at least"):
        chunking.chunks(frame(spark, texts), 4)
