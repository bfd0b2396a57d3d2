"""Byte-level BPE by relational contraction: DuckDB recursive queries inside each partition.

A text is split by the tokenizer's pattern.  Words that a worker has not met go to DuckDB, one row a
token position.  A recursive query joins neighbouring positions with the merge table and contracts
each word's pair of minimum rank, the leftmost first, until no pair of any word merges.  Decoding is
the ordered aggregation of the tokens' bytes, again a query over token-position rows.

A recursion keeps the ids of all its rounds, half the square of a word's length, so words are dealt to
recursions by their lengths squared (``ROOM``): memory is bounded whatever the words.  Words repeat, so a
worker keeps the ids of those met, and their bytes decoded from those ids (caches of bounded size: when
full they are emptied, never consulted for less).  Words of over ``LONG_WORD`` bytes would need as many
rounds as bytes; they take an exact heap merge with the same rule.

Defined results: null text is the empty text (no ids); very long texts are encoded whole, in runs of
``pieces.BATCH_CHARS`` characters of texts; repeated rows are encoded one by one; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from needlework.llm.common import gc_paused, only
from needlework.llm.pieces import Table, slices
from needlework.plans.layout import spread

LONG_WORD = 512
#: Words, and pieces, that a worker keeps: about 300 bytes each, so some 200 MB of a worker in all.
CACHE_WORDS = 350_000
#: Characters of the words that it keeps.
CACHE_CHARS = 16_000_000
#: Words of one recursion, and the sum of their squared lengths: twice the ids that its rounds hold.
WORDS, ROOM = 20_000, 1 << 26


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line a token, its base64 bytes and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_rows(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """(left id, right id, merged id) of every pair of tokens whose joined bytes are a token."""
    left, right, merged = [], [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                merged.append(rank)
    return left, right, merged


#: A round unfolds every word into token-position rows, joins neighbours with the merge table, takes
#: each word's leftmost pair of minimum rank and contracts it.  A word without a pair leaves the
#: recursion; its last round is its encoding.
_CONTRACT = """
WITH RECURSIVE step(word, round, ids) AS (
  SELECT word, 0, ids FROM start
  UNION ALL
  SELECT s.word, s.round + 1, s.ids[:best.pos - 1] || [best.merged] || s.ids[best.pos + 2:]
  FROM step s JOIN (
    SELECT word, CAST(min(pick) % 1024 AS INTEGER) AS pos, CAST(min(pick) // 1024 AS INTEGER) AS merged
    FROM (
      SELECT q.word, m.merged::BIGINT * 1024 + q.pos AS pick
      FROM (
        SELECT word, unnest(ids[:-2]) AS id, unnest(ids[2:]) AS next_id, unnest(range(1, len(ids))) AS pos
        FROM step WHERE len(ids) > 1
      ) q JOIN merges m ON m.a = q.id AND m.b = q.next_id
    ) GROUP BY word
  ) best ON best.word = s.word
)
SELECT word, arg_max(ids, round) AS ids FROM step GROUP BY word
"""


class Coder:
    """The encoder and decoder of one rank file, in one Python worker."""

    def __init__(self, rank_path: str, pattern: str):
        import duckdb
        import regex

        ranks = read_ranks(rank_path)
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        a, b, merged = merge_rows(ranks)
        pairs = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "merged": pa.array(merged, pa.int32())})
        tokens = pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": pa.array([t.hex() for t in ranks], pa.string())})  # bytes in hexadecimal
        self._load("merges", pairs)
        self._load("tokens", tokens)
        self.split = regex.compile(pattern).findall
        self.words: dict[str, tuple[int, str, bytes]] = {}
        self.chars = 0
        self.pieces = Table(self.code_pieces, CACHE_WORDS)

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, contracted by the recursive query (long words: by a heap)."""
        return [ids for some in _dealt(words) for ids in self._contract(some)[0].to_pylist()]

    def _contract(self, words: list[bytes]) -> tuple[pa.ListArray, list[str]]:
        """The ids of each word, and the same in decimal joined by a space."""
        short = [k for k, w in enumerate(words) if len(w) <= LONG_WORD]
        long = [k for k, w in enumerate(words) if len(w) > LONG_WORD]
        merged = [self._heap_merge(words[k]) for k in long]
        flat = self.byte_ids[np.frombuffer(b"".join([words[k] for k in short]), np.uint8)]
        ends = np.cumsum([0, *[len(words[k]) for k in short]])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        self._load("start", pa.table({"word": pa.array(short, pa.int32()), "ids": ids}))
        self._load("ready", pa.table({"word": pa.array(long, pa.int32()), "ids": pa.array(merged, pa.list_(pa.int32()))}))
        found = self.db.sql(f"SELECT ids, array_to_string(ids, ' ') AS said FROM ({_CONTRACT} UNION ALL SELECT * FROM ready) ORDER BY word").to_arrow_table()
        return found.column(0).combine_chunks(), found.column(1).to_pylist()

    def _heap_merge(self, w: bytes) -> list[int]:
        """The same contraction for one long word, in n log n: a heap of (rank, position) over a linked list."""
        ranks = self.ranks
        part: list[bytes | None] = [w[i : i + 1] for i in range(len(w))]
        after, before = list(range(1, len(w) + 1)), list(range(-1, len(w) - 1))
        heap = [(r, i, 2) for i in range(len(w) - 1) if (r := ranks.get(w[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, length = heapq.heappop(heap)
            j = after[i] if part[i] is not None else len(w)
            if j >= len(w) or len(part[i]) + len(part[j]) != length:
                continue
            part[i] += part[j]
            part[j] = None
            after[i] = after[j]
            if after[j] < len(w):
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(w):
                    joined = part[left] + part[right]
                    if (r := ranks.get(joined)) is not None:
                        heapq.heappush(heap, (r, left, len(joined)))
        return [ranks[p] for p in part if p is not None]

    def decode_ids(self, sequences: list[list[int]]) -> list[bytes]:
        """Bytes of each id sequence: token rows aggregated in order of position."""
        return self._decode(pa.array(sequences, pa.list_(pa.int32())))

    def _decode(self, sequences: pa.ListArray) -> list[bytes]:
        out = [b""] * len(sequences)
        sizes = np.asarray(sequences.value_lengths()).astype(np.int64) if len(sequences) else np.zeros(0, np.int64)
        seq = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(seq)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self._load("coded", pa.table({"seq": pa.array(seq, pa.int32()), "pos": pa.array(pos, pa.int32()), "id": sequences.flatten()}))
        found = self.db.sql("SELECT seq, string_agg(bytes, '' ORDER BY pos) FROM coded JOIN tokens USING (id) GROUP BY seq").to_arrow_table()
        for k, said in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
            out[k] = bytes.fromhex(said)
        return out

    def code_pieces(self, pieces: list[str]) -> list[tuple[int, str, bytes]]:
        """(number of ids, ids in decimal joined by a space, decoded bytes) of each piece."""
        words, parts = self.words, list(map(self.split, pieces))
        if len(words) > CACHE_WORDS or self.chars > CACHE_CHARS:
            words.clear()
            self.chars = 0
        unmet = sorted(set(filterfalse(words.__contains__, chain.from_iterable(parts))), key=len)  # like lengths end in like rounds
        self.chars += sum(map(len, unmet))
        for some in _dealt([w.encode("utf-8") for w in unmet]):
            coded, said = self._contract(some)
            met, unmet = unmet[: len(some)], unmet[len(some) :]
            words.update(zip(met, zip(coded.value_lengths().to_pylist(), said, self._decode(coded), strict=True), strict=True))
        return [words[ws[0]] if len(ws) == 1 else _joined([words[w] for w in ws]) for ws in parts]

    def code(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """The same of whole texts."""
        return map(_joined, self.pieces.values(texts))


def _dealt(words: list[bytes]) -> Iterator[list[bytes]]:
    """The words in order, in runs of at most WORDS words whose squared lengths come to ROOM; long words take no room."""
    run, room = [], 0
    for w in words:
        need = len(w) ** 2 if len(w) <= LONG_WORD else len(w)
        if run and (len(run) == WORDS or room + need > ROOM):
            yield run
            run, room = [], 0
        run.append(w)
        room += need
    if run:
        yield run


def _joined(found: list[tuple[int, str, bytes]]) -> tuple[int, str, bytes]:
    if not found:
        return 0, "", b""
    counts, ids, back = zip(*found, strict=True)
    return sum(counts), " ".join(ids), b"".join(back)


@lru_cache(maxsize=2)
def coder(rank_path: str, pattern: str) -> Coder:
    """One coder a worker process and rank file."""
    return Coder(rank_path, pattern)


def encode(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>): the ids of every whole text."""
    rows = spread(only(docs, **{key: "long", "text": "string"}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(rank_path, pattern)
        for batch in batches:
            for keys, texts in slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with gc_paused():
                    ids = [[int(x) for x in s.split()] for _, s, _ in own.code(texts)]
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return rows.mapInArrow(run, f"{key} long, ids array<int>")


def decode(coded: DataFrame, rank_path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, bytes binary): the bytes of every row's ``ids``, by ordered aggregation; null ids: empty."""
    rows = only(coded, **{key: "long", "ids": "array<int>"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(rank_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                back = own.decode_ids([x or [] for x in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(back, pa.binary())], names=[key, "bytes"])

    return rows.mapInArrow(run, f"{key} long, bytes binary")


def digests(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded."""
    rows = spread(only(docs, **{key: "long", "text": "string"}))
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(rank_path, pattern)
        for batch in batches:
            for keys, texts in slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with gc_paused():
                    got = list(own.code(texts))
                columns = [
                    keys,
                    [n for n, _, _ in got],
                    [hashlib.sha256(s.encode()).hexdigest() for _, s, _ in got],
                    [hashlib.sha256(b).hexdigest() for _, _, b in got],
                ]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
