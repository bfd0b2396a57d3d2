import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from needlework.llm import bpe, quality_rules, registry, simhash, token_file
from needlework.llm.common import connected_components, table
from tests.llm.fixtures import documents, frame

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sources(spark, sf_dir):
    yield [(r["doc_id"], r["text"], r["source"]) for r in table(spark, sf_dir, "documents").collect()], table(spark, sf_dir, "documents")
    yield [(r[0], r[1], r[3]) for r in documents()], frame(spark)
    yield [], frame(spark, [])


def test_bpe_equals_the_library(spark, sf_dir):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for rows, df in sources(spark, sf_dir):
        want = []
        for key, text, _ in rows:
            ids = own.encode_ordinary(text or "")
            want.append((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
        assert rows_of(bpe.digests(df, RANKS, P.PATTERN)) == sorted(want, key=repr)


def test_bpe_round_trip(spark):
    coded = bpe.encode(frame(spark), RANKS, P.PATTERN)
    want = sorted(((r[0], (r[1] or "").encode()) for r in documents()), key=repr)
    assert sorted(((r[0], bytes(r[1])) for r in bpe.decode(coded, RANKS, P.PATTERN).collect()), key=repr) == want


def test_long_words_contract_alike(monkeypatch):
    own = bpe.Coder(RANKS, P.PATTERN)
    words = [b"a" * 300, b"abcabc" * 50, "éß".encode() * 40, bytes(range(33, 120)) * 3]
    short = own.encode_words(words)
    monkeypatch.setattr(bpe, "LONG_WORD", 1)
    assert own.encode_words(words) == short


def test_bpe_of_long_words_is_bounded(monkeypatch):
    own = bpe.Coder(RANKS, P.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rnd = np.random.default_rng(4)
    spaced = " ".join("".join(map(chr, rnd.integers(97, 123, 480))) for _ in range(60))
    unspaced = "".join(map(chr, rnd.integers(0x4E00, 0x9000, 60_000)))
    monkeypatch.setattr(bpe, "ROOM", 1 << 20)
    assert max(map(len, bpe._dealt([b"x" * 480] * 60))) == (1 << 20) // 480**2
    for text, (n, said, back) in zip([spaced, unspaced], own.code([spaced, unspaced]), strict=True):
        assert list(map(int, said.split())) == plain.encode_ordinary(text) and back == text.encode() and n == len(said.split())


def brute_rules(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_equal_brute_force(spark, sf_dir):
    for rows, df in sources(spark, sf_dir):
        judged = quality_rules.judge(df)
        want = []
        for key, text, _ in rows:
            n, *rest = brute_rules(text)
            want.append((key, n, *rest, n < 20 or 100 * rest[-1] > 30 * n))
        assert rows_of(judged.drop("kept")) == sorted(want, key=repr)
        assert judged.where("base_failed and kept").count() == 0


def test_quality_hosts_act_on_the_table(spark):
    judged = quality_rules.judge(table(spark, "/root/testdata/sf0.01", "documents"))
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    gone = judged.where("not kept and not base_failed")
    assert gone.count() > 0 and gone.join(labels.where("quality = 1"), "doc_id").count() == 0  # hosts act, on no clean document


def test_quality_verdicts(spark):
    good, noisy = " ".join(f"word{i}" for i in range(40)), " ".join(f"word{i}###" for i in range(40))
    rows = [(i, noisy if i % 10 else good, None, "bad", None, None, None) for i in range(200)]
    rows += [(1000 + i, good if i % 10 else noisy, None, "fine", None, None, None) for i in range(200)]
    kept = {r["doc_id"] for r in quality_rules.judge(frame(spark, rows)).where("kept").collect()}
    assert kept == {i for i in range(0, 200, 10)} | {1000 + i for i in range(200)}
    assert {r["doc_id"] for r in quality_rules.keep(frame(spark, rows)).collect()} == kept
    assert quality_rules.keep(frame(spark, rows)).columns == frame(spark, rows).columns


def brute_print(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {n: root(n) for n in nodes}


def test_simhash_equals_brute_force(spark, sf_dir):
    for rows, df in sources(spark, sf_dir):
        prints = [(key, brute_print(text)) for key, text, _ in rows]
        values = sorted({p for _, p in prints})
        near = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 4]
        group = brute_components(values, near)
        least = {}
        for key, p in prints:
            if key is not None:
                least[group[p]] = min(key, least.get(group[p], key))
        want = [(key, f"{p:016x}", least.get(group[p])) for key, p in prints]
        assert rows_of(simhash.near_duplicates(df)) == sorted(want, key=repr)


@pytest.mark.parametrize(("pairs", "block"), [(1 << 20, 8192), (50, 8192), (1 << 20, 60)])
def test_simhash_links_planted_flips(spark, monkeypatch, pairs, block):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = np.random.default_rng(3)
    centres = [int(x) for x in rnd.integers(0, 2**63, 300)]
    prints = list(centres)
    for c in centres[:150]:
        for _ in range(3):
            x = c
            for b in rnd.choice(64, int(rnd.integers(1, 7)), replace=False):
                x ^= 1 << int(b)
            prints.append(x)
    dense = centres[0]
    prints += [dense ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)]
    values = sorted(set(prints))
    near = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 4]
    group = brute_components(values, near)
    signed = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)]
    found = simhash.components(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    least = {}
    for i, p in enumerate(prints):
        least[group[p]] = min(i, least.get(group[p], i))
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: least[group[p]] for i, p in enumerate(prints)}


def test_components(spark):
    rnd = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(200)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = brute_components(nodes, [e for e in edges if e[0] != e[1]])
    assert dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect())) == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_file_equals_the_library(spark, sf_dir, monkeypatch):
    own = Tokenizer.from_file(JSON)
    special = [(1, "a<|endoftext|>b <|endoftext|>\nx<|endoftext|>", "s"), (2, "<|endoftext|>", "s"), (3, "a <|endof text|>", "s")]
    for rows, df in [*sources(spark, sf_dir), (special, frame(spark, [(k, t, None, s, None, None, None) for k, t, s in special]))]:
        start, want = 0, []
        for key, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
            want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = token_file.digests(df, JSON, 2, 50_257)
        nulls = lambda rows: sorted(r[2:] for r in rows if r[0] is None)  # noqa: E731  ties among null keys go by text
        assert sorted(r for r in map(tuple, got.collect()) if r[0] is not None) == sorted(r for r in want if r[0] is not None)
        assert nulls(map(tuple, got.collect())) == nulls(want)


def test_token_file_keyed_access(spark, tmp_path, monkeypatch):
    own = Tokenizer.from_file(JSON)
    rows = documents()
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    for width in (50_257, 1 << 20):
        path = f"file://{tmp_path}/tokens-{width}"
        token_file.write(frame(spark), JSON, path, 2, width)
        keys = [0, 5, 33, 70, 10**9, -(2**63)]
        got = {r["key"]: r["ids"] for r in token_file.lookup(spark, path, keys).collect()}
        assert got == {k: [*own.encode(text[k] or "", add_special_tokens=False).ids, 2] for k in keys if k in text}
        assert [r["key"] for r in token_file.lookup(spark, path, [None, 10**9]).collect()] == [None]
        assert {r["key"] for r in token_file.lookup(spark, path, list(range(-500, 500))).collect()} == set(text)


def test_fingerprints_refuse_absent_keys(monkeypatch):
    docs = [(None, b"\1\0"), (None, b"\2\0"), (-(2**63), b"\3\0"), *((k, bytes([k, 0])) for k in range(5, 200, 3) for _ in range(2))]
    shard = token_file.Shard(token_file.pack(docs, 2))
    assert [(k, ids.tolist()) for k, _, ids in shard.documents()] == [(k, [raw[0]]) for k, raw in docs]
    assert [k for k in range(-300, 300) if shard.find(k) is not None] == list(range(5, 200, 3)) and shard.find(5, 1) is not None and shard.find(5, 2) is None
    keys = np.arange(10**6, 10**6 + 5000)
    h = token_file._hash(keys, np.zeros(5000, np.int64))
    at = token_file._slot(h, shard.seeds[(h % np.uint64(len(shard.seeds))).astype(np.int64)], shard.n)
    assert (shard.prints[at] == (h >> np.uint64(32)).astype(np.uint32)).sum() == 0  # the stored fingerprint alone refuses them


def test_index_is_perfect_and_minimal():
    for n in (1, 2, 7, 500, 4096):
        h = token_file._hash(np.arange(n) * 3 - 5, np.zeros(n, np.int64))
        seeds, slots = token_file.build_index(h)
        assert sorted(slots.tolist()) == list(range(n))
        bucket = (h % np.uint64(len(seeds))).astype(np.int64)
        assert (token_file._slot(h, seeds[bucket], n) == slots).all()


def test_queries_run(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    for name in ("op2_byte_bpe", "op3_quality_rules", "op4_simhash", "op6_token_file"):
        assert registry.queries()[name](spark, sf_dir).count() == n, name
