"""Searches against plain bytes and strings: fixed cases, awkward cases, random ones."""

import io
import random
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from needlework import cli
from needlework.functions import search
from needlework.operators import batch, listing, profile, store
from needlework.operators.repeats import Options
from needlework.sources import files


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "hay_id long, text string")


def starts(text, needle):
    return [i for i in range(len(text) - len(needle) + 1) if needle and text.startswith(needle, i)]


def greedy(text, needle):
    out, at = [], 0
    while needle and (at := text.find(needle, at)) >= 0:
        out.append(at)
        at += len(needle)
    return out


TEXTS = [
    "", "q", "zyxwvutsrq0123456789", "a river runs past the old stone mill", "z" * 37, "xyx" * 9, "again and again", "bbbb", "pqrpqrpqr",
    "mnOmnPPmnQQQmn", "pqrpqrpqrSTU", "cdcdc dcdcdc", "a stack of hay, a needle, another needle", "naïve éé é\n\x00\x00", r"a\Eb\Q.*c\Eb", "b" * 9999 + "c",
]
WANTED = ["", "q", "xyx", "zyx", "mill", "zzz", "past", "kk", "again", "ll", "st", "w", "cd", "PP", "QQQ", "mnQ", "cdc", "é", "\x00", "\\E", ".*", "\\Eb", "bbbbc", "bb", "needle", "z" * 50]


def check_all(spark, texts, needles):
    rows = frame(spark, texts).withColumn("needle", F.explode(F.array(*map(F.lit, needles))))
    n = F.col("needle")
    got = rows.select(
        "text", "needle", search.find("text", n).alias("find"), search.find_bytes("text", n).alias("bytes"), search.count("text", n).alias("count"),
        search.count("text", n, True).alias("overlap"), search.has("text", n).alias("has"), search.find_all("text", n).alias("all"), search.find_all("text", n, True).alias("every"),
    ).collect()
    assert len(got) == len(texts) * len(needles)
    for r in got:
        text, needle = r["text"], r["needle"]
        assert r["find"] == text.find(needle), (text[:40], needle)
        assert r["bytes"] == text.encode().find(needle.encode())
        assert r["count"] == (text.count(needle) if needle else 0)
        assert r["overlap"] == len(starts(text, needle)) and r["has"] == (needle in text)
        assert r["all"] == greedy(text, needle) and r["every"] == starts(text, needle)


def test_fixed_cases(spark):
    check_all(spark, TEXTS, WANTED)


def test_needles_across_block_borders(spark):
    texts = []
    for at in range(8187, 8195):
        base = ["x"] * 20_000
        base[at : at + 4] = "ABCD"
        texts.append("".join(base))
        base[15_000:15_004] = "ABCD"
        texts.append("".join(base))
    check_all(spark, texts, ["ABCD", "xA", "Dx"])
    hits = {(r["hay_id"], r["block"]) for r in profile.candidate_blocks(frame(spark, texts), "ABCD").collect()}
    assert hits == {(i, p // 8192) for i, t in enumerate(texts) for p in starts(t, "ABCD")}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab\n.é\\E", max_size=40), min_size=1, max_size=8), st.lists(st.text("ab\n.é\\E", max_size=4), min_size=1, max_size=5))
def test_random_cases(spark, texts, needles):
    check_all(spark, texts, list(dict.fromkeys(needles)))


def test_bytes_mode(spark):
    rnd = random.Random(4)
    raw = [bytes(rnd.randrange(256) for _ in range(300)) for _ in range(20)] + [b"", b"\x00\xff\xab\x80"]
    needles = [b"\x00", b"\xff\xab", raw[0][10:13], b"a"]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "hay_id long, b binary").withColumn("text", search.latin("b"))
    for needle in needles:
        got = rows.select("hay_id", search.find("text", needle.decode("latin-1")).alias("off"), search.unlatin("text").alias("b")).collect()
        assert all(r["off"] == raw[r["hay_id"]].find(needle) and bytes(r["b"]) == raw[r["hay_id"]] for r in got)


def test_nulls(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "a", None)], "hay_id long, text string, needle string")
    n = F.col("needle")
    found = rows.select(search.find("text", n), search.find_bytes("text", n), search.count("text", n), search.count("text", n, True), search.has("text", n), search.find_all("text", n)).collect()
    assert all(v is None for r in found for v in r)


@pytest.mark.parametrize("overlap", [False, True])
def test_listing(spark, overlap):
    rows = listing.find_all_rows(frame(spark, [*TEXTS, None]), WANTED, overlap).collect()
    want = {(i, w, o) for i, t in enumerate(TEXTS) for w in WANTED for o in (starts if overlap else greedy)(t, w)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    capped = {tuple(r) for r in listing.find_all_rows(frame(spark, TEXTS), WANTED, overlap, 2).collect()}
    assert capped == {(i, w, o) for i, t in enumerate(TEXTS) for w in WANTED for o in (starts if overlap else greedy)(t, w)[:2]}
    assert listing.find_all_rows(frame(spark, TEXTS), [""]).count() == 0


def test_strategies_agree(spark, monkeypatch):
    rnd = random.Random(9)
    alphabet = "".join(rnd.choices("abcdefghjkmnpqrstuvwxy", k=7000))
    needles = {alphabet[o : o + 2 + i % 7] for i, o in enumerate(range(0, 6000, 43))} | {f"+{i}+" for i in range(50)} | {"", "a", "ab", "abc"}
    texts = [alphabet, "", *["".join(rnd.choice("abc") for _ in range(60)) for _ in range(20)], None]
    hays, rows = frame(spark, texts), spark.createDataFrame([(w,) for w in [*needles, "ab", "abc"]], "needle string")
    want = {(i, w) for i, t in enumerate(texts) if t is not None for w in needles if w in t}
    for strategy, rows_out, block in (("join", 1 << 16, 1 << 18), ("scan", 1 << 16, 1 << 18), ("scan", 7, 1 << 18), ("scan", 1 << 16, 500), ("join", 1 << 16, 500), ("auto", 1 << 16, 1 << 18)):
        monkeypatch.setattr(batch, "OUT_ROWS", rows_out)
        monkeypatch.setattr(batch, "BLOCK_BYTES", block)
        got = batch.has_pairs(hays, rows, strategy).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        for overlap in (False, True):
            counts = {tuple(r) for r in batch.count_pairs(hays, rows, overlap, strategy).collect()}
            assert counts == {(i, w, len((starts if overlap else greedy)(texts[i], w))) for i, w in want if w}
        assert {r[0] for r in batch.has_semi(hays, rows, strategy).collect()} == {w for _, w in want}
        assert {r[0] for r in batch.has_anti(hays, rows.where("needle = 'abc'"), strategy).collect()} == {i for i, t in enumerate(texts) if t is None or "abc" not in t}
    assert batch.has_pairs(hays, rows.where("1 = 0")).count() == 0
    for overlap in (False, True):
        met = {w: sum(w in t for t in texts if t is not None) for w in needles}
        often = {w: sum(len((starts if overlap else greedy)(t, w)) for t in texts if t) for w in needles}
        assert {tuple(r) for r in batch.totals(hays, rows, overlap).collect()} == {(w, n, often[w]) for w, n in met.items() if n}
    assert batch.has_bits(frame(spark, ["an old stone mill"]), ["old", "new", "mill", "", "old"]).first()["bits"] == [True, False, True, True, True]
    assert batch.count_list(frame(spark, ["pqrpqrpqrSTU"]), ["pqr", "STU", "none", ""]).first()["counts"] == [3, 1, 0, 0]


def test_profiles(spark):
    from collections import Counter
    from math import log2

    texts = ["", "aaaa", "abcd" * 50, "".join(chr(33 + i % 90) for i in range(5000)), "é" * 10, "x" * 200_000 + "y", None]
    rows = {r["hay_id"]: r for r in profile.entropy(frame(spark, texts)).collect()}
    labels = {r["hay_id"]: r["label"] for r in profile.label(frame(spark, texts)).collect()}
    found = {r["hay_id"]: r["bytes"] for r in profile.presence(frame(spark, texts)).collect()}
    for i, text in enumerate(texts[:-1]):
        data = text.encode()[: profile.SAMPLE]
        n = len(data) or 1
        h = -sum(c / n * log2(c / n) for c in Counter(data).values())
        assert rows[i]["n"] == len(data) and rows[i]["entropy"] == pytest.approx(h, abs=2e-6)
        assert labels[i] == ("high" if h <= 3.5 else "mixed" if h <= 5.5 else "low")
        assert found[i] == sorted({f"{b:02X}" for b in text.encode()})
    assert rows[6]["n"] is None and labels[6] == "mixed"
    assert {r[0] for r in profile.label(frame(spark, ["a"]), 0).select("label").collect()} == {"mixed"}
    may = [r["may"] for r in profile.may_contain(frame(spark, ["stone mill", "xyz", ""]), "stone").orderBy("hay_id").collect()]
    assert may == [True, False, False]
    assert profile.may_contain(frame(spark, ["a"]), "").first()["may"]


def test_store(spark, tmp_path):
    texts = ["a needle", "b", "a needle", "a needle", None, "b"]
    kept = store.intern(frame(spark, texts))
    assert {(r["handle"], r["text"], r["refs"]) for r in kept.collect()} == {(0, "a needle", 3), (1, "b", 2), (4, None, 1)}
    gone = spark.createDataFrame([(1,), (1,), (0,), (77,)], "handle long")
    left = store.release(kept, gone)
    assert {(r["handle"], r["refs"]) for r in left.collect()} == {(0, 2), (4, 1)}
    store.save(left, f"{tmp_path}/store")
    assert store.load(spark, f"{tmp_path}/store").count() == 2
    assert [r["off"] for r in store.memo_find(frame(spark, texts), "needle").orderBy("hay_id").collect()] == [2, -1, 2, 2, None, -1]
    assert [r["n"] for r in store.memo_count(frame(spark, texts), "e").orderBy("hay_id").collect()] == [3, 0, 3, 3, None, 0]
    line = store.stats(frame(spark, texts)).first()
    assert tuple(line) == (3, 6, 26, 9)
    assert '"dedup_ratio":2.888889' in store.stats_json(frame(spark, texts)).first()["json"]
    assert [bytes(r["bytes"]) for r in store.read_range(frame(spark, ["hello", "h", "é"]), 1, 3).orderBy("hay_id").collect()] == [b"ell", b"", b"\xa9"]


def test_kept_profiles(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcdefg é") for _ in range(n)) for n in (0, 100, 4095, 4096, 40_000, 9000)] + [None]
    texts[4] = texts[4][:8190] + "NEEDLE" + texts[4][8196:]
    kept = profile.build(frame(spark, texts), 2).cache()
    for needle in ("NEEDLE", "abc", "zq", "", "éa", "NEEDLX"):
        may = {r["hay_id"]: r["may"] for r in profile.may_contain_profiled(kept, needle).collect()}
        own = {r["hay_id"]: r["may"] for r in profile.may_contain(frame(spark, texts), needle).collect()}
        found = {r["hay_id"]: r["blocks"] for r in profile.profiled_blocks(kept, needle).collect()}
        for i, t in enumerate(texts[:-1]):
            assert may[i] or needle not in t
            assert own[i] == (set(needle.encode()) <= set(t.encode()))
            at = {x // 8192 for x in range(len(t.encode())) if needle and t.encode().startswith(needle.encode(), x)}
            assert found[i] is None or at <= set(found[i])
    assert {r["hay_id"]: r["blocks"] for r in profile.profiled_blocks(kept, "NEEDLE").collect()}[4] == [len(texts[4][:8190].encode()) // 8192]
    assert {r["hay_id"]: r["blocks"] for r in profile.profiled_blocks(kept, "abc").collect()}[4] is None  # more than half of the blocks
    assert profile.build(frame(spark, texts), 0).where("hist is null and entropy is null and grams is null and label = 'mixed'").count() == 7


def test_memo_tables(spark, tmp_path):
    texts = ["a needle", "b", "a needle", None, ""]
    contents = store.intern(frame(spark, texts))
    store.save(store.remember(contents, ["a"]).withColumn("n", F.col("n") + 100), f"{tmp_path}/memo")  # marked, to be told apart
    got = {(r["handle"], r["needle"]): (r["off"], r["n"]) for r in store.remember(contents, ["a", "e"], f"{tmp_path}/memo").collect()}
    assert got == {(0, "a"): (0, 101), (1, "a"): (-1, 100), (4, "a"): (-1, 100), (0, "e"): (3, 3), (1, "e"): (-1, 0), (4, "e"): (-1, 0)}
    assert {(r["hay_id"], r["handle"]) for r in store.handles(frame(spark, texts)).collect()} == {(0, 0), (1, 1), (2, 0), (3, 3), (4, 4)}
    rows = store.repeats_in(frame(spark, ["abcabcabcabc xy", None, "", "abcabcabcabc xy"]), Options(3, 16, 2, 4)).collect()
    assert {r["hay_id"] for r in rows} == {0, 3} and len({(r["off"], r["len"], r["n"], bytes(r["sub"])) for r in rows}) * 2 == len(rows)


def test_staged_tables_go(spark):
    from pathlib import Path

    from needlework.plans import staging

    here = lambda df: Path(df._needlework_path.removeprefix("file://")).exists()
    one = staging.stage(spark.range(3), "one")
    with staging.scratch(spark):
        two = staging.stage(spark.range(4), "two")
        three = staging.kept(two, "three")
        assert here(two)
    assert not here(two) and here(one) and three.count() == 4
    path = Path(one._needlework_path.removeprefix("file://"))
    staging.drop(one, three, spark.range(2))
    assert not path.exists() and not hasattr(three, "_needlework_path")


def test_content_hash(spark):
    import xxhash

    texts = ["", "a", "é" * 50]
    got = [r["h"] for r in frame(spark, texts).select("hay_id", search.content_hash("text").alias("h")).orderBy("hay_id").collect()]
    assert got == [xxhash.xxh64_intdigest(t.encode(), 42) - (2**64 if xxhash.xxh64_intdigest(t.encode(), 42) >= 2**63 else 0) for t in texts]


def test_token_protocol():
    tokens = [b"abc", b"", b"\x00\xff", b"x" * 5000]
    assert files.decode_tokens(files.encode_tokens(tokens)) == tokens
    with pytest.raises(ValueError, match="limit"):
        files.decode_tokens(files.encode_tokens(tokens), files.HAS_LIMIT)
    for cut in (2, 6, 9):
        with pytest.raises(ValueError, match="early"):
            files.decode_tokens(files.encode_tokens([b"abc", b"d"])[:cut])
    assert files.presence_bytes([True, False]) == b"\x01\x00" and files.count_words([1, 2**32 + 5]) == struct.pack("<II", 1, 5)


def test_command_line(spark, tmp_path):
    path = tmp_path / "hay"
    path.write_bytes(b"hello " * 1000 + b"world \xff\x00 aaaa")

    def run(*argv, request=None):
        out = io.BytesIO()
        assert cli.main([*argv], spark, request, out) == 0
        return out.getvalue()

    assert run("find", str(path), "world") == b"6000\n" and run("find", str(path), "nope") == b"-1\n"
    assert run("count", str(path), "hello") == b"1000\n" and run("count", str(path), "aa") == b"2\n" and run("count", str(path), "aa", "1") == b"3\n"
    request = files.encode_tokens([b"hello", b"nope", b"", b"\xff\x00", b"hello"])
    assert run("has", str(path), request=request) == run(str(path), request=request) == b"\x01\x00\x01\x01\x01"
    assert run("count-batch", str(path), request=request) == struct.pack("<5I", 1000, 0, 0, 1, 1000)
    text = tmp_path / "text"
    text.write_bytes(b"pqrSTUpqrSTUpqr\xff~~tumtum~~~pqrSTU")
    lines = run("repeats", str(text), "3", "16", "8").decode().splitlines()
    assert 0 < len(lines) <= 8 and all(len(x.split("\t")) == 4 for x in lines)


def test_streams(spark, tmp_path):
    from needlework.streaming import search as streams

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, if(id % 3 = 0, 'the fox', 'a dog the the') AS text FROM range(30)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")

    def collect(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    found = collect(streams.matches(stream, ["the", "fox", "zzz"]), "hits")
    assert len(found) == 30 + 10 and {(r["needle"], r["off"], r["n"]) for r in found} == {("the", 0, 1), ("the", 6, 2), ("fox", 4, 1)}
    assert len(collect(streams.first_contents(stream, "ts", "1 hour"), "firsts")) == 2
    q = streams.hits_by_window(stream, ["the"], "ts", "10 minutes", "10 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    windows = spark.table("windows").collect()
    assert len(windows) == 3 and sum(r["hits"] for r in windows) == 30 and sum(r["n"] for r in windows) == 50


def test_profiled_and_script_forms(spark):
    from needlework.functions import sql

    texts = ["hello world", "no", "", None, "ababab"]
    got = {r["hay_id"]: (r["off"], r["n"]) for r in profile.find_profiled(frame(spark, texts), "ab", True).collect()}
    assert got == {0: (-1, 0), 1: (-1, 0), 2: (-1, 0), 3: (None, None), 4: (0, 3)}
    names = sql.register(spark)
    rows = spark.sql("SELECT " + ", ".join(f"{n}('aXa', 'Xa'), {n}('aXa', '')" for n in names)).first()
    assert list(rows) == [1, 0, 1, 0, True, True, 1, 0, 1, 0]
    forms = frame(spark, ["aaaa"]).select(sql.position("text", "b"), sql.position("text", "a"), sql.positions("text", ""), sql.positions("text", "aa", True, 2)).first()
    assert list(forms) == [None, 0, [0], [0, 1]]
    maps = {r["hay_id"]: r["repeats"] for r in sql.repeats_map(frame(spark, ["short short", "LINE_OF_A_PATTERN_" * 20, None])).collect()}
    assert maps[0] is None and maps[2] is None and all(("LINE_OF_A_PATTERN_" * 20).count(bytes.fromhex(k).decode()) == n for k, n in maps[1].items()) and maps[1]
