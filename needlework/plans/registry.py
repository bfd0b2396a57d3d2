"""The queries of the search engine over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework.functions import search
from needlework.functions import sql as sql_forms
from needlework.operators import batch, chunking, listing, profile, repeats, store
from needlework.operators.repeats import Options
from needlework.plans import staging

Query = Callable[[SparkSession, str], DataFrame]
NEEDLES = ("the", "tion", "zzz", "aa", "é")
LISTED = ("the", "idiot", "", "zzz", "the", "é")
SQL_NEEDLES = "(VALUES ('the'),('tion'),('zzz'),('aa'),('é')) n(needle)"

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _hays(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(key).cast("long").alias("hay_id"), F.col(text).alias("text"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of four letters or more in the benchmark."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.split("text", "[^a-zA-Z]+")).alias("needle"))
    return rows.where(F.length("needle") >= 4).distinct()


def _crossed(hays: DataFrame, needles: tuple[str, ...] = NEEDLES) -> DataFrame:
    """Each haystack once for every stated needle."""
    return hays.withColumn("needle", F.explode(F.array(*map(F.lit, needles))))


WORDS = "(SELECT DISTINCT w AS needle FROM (SELECT unnest(regexp_split_to_array(text,'[^a-zA-Z]+')) AS w FROM benchmark) WHERE length(w) >= 4)"
CROSSED = f"documents CROSS JOIN {SQL_NEEDLES}"
GRAMS = """(SELECT doc_id AS hay_id, i, c || coalesce(lead(c) OVER w, '') || coalesce(lead(c, 2) OVER w, '') || coalesce(lead(c, 3) OVER w, '') AS g
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c, unnest(range(0, length(text))) AS i FROM documents) WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""
STARTS = f"(SELECT hay_id, needle, i FROM {GRAMS} g JOIN {SQL_NEEDLES} ON starts_with(g, needle))"


# single needles


@query(f"SELECT doc_id AS hay_id, needle, CAST(instr(text, needle) - 1 AS BIGINT) AS off FROM {CROSSED}")
def find_first(spark, sf_dir):
    return _crossed(_hays(spark, sf_dir)).select("hay_id", "needle", search.find("text", F.col("needle")).alias("off"))


@query(f"SELECT doc_id AS hay_id, needle, CAST(CASE WHEN instr(text, needle) = 0 THEN -1 ELSE strlen(substr(text, 1, instr(text, needle) - 1)) END AS BIGINT) AS off FROM {CROSSED}")
def find_first_bytes(spark, sf_dir):
    return _crossed(_hays(spark, sf_dir)).select("hay_id", "needle", search.find_bytes("text", F.col("needle")).alias("off"))


@query(f"SELECT doc_id AS hay_id, needle, CAST(CASE WHEN instr(text, needle) = 0 THEN -1 ELSE strlen(substr(text, 1, instr(text, needle) - 1)) END AS BIGINT) AS off FROM {CROSSED}")
def find_first_binary(spark, sf_dir):
    """The same over BINARY: a character stands for a byte."""
    rows = _crossed(_hays(spark, sf_dir))
    hay, needle = (search.latin(F.encode(c, "UTF-8")) for c in ("text", "needle"))
    return rows.select("hay_id", "needle", search.find(hay, needle).alias("off"))


@query("SELECT doc_id AS hay_id, CAST(instr(text, '') - 1 AS BIGINT) AS off, CAST(0 AS BIGINT) AS n, contains(text, '') AS has FROM documents")
def empty_needle(spark, sf_dir):
    return _hays(spark, sf_dir).select("hay_id", search.find("text", "").alias("off"), search.count("text", "").alias("n"), search.has("text", "").alias("has"))


@query(f"SELECT doc_id AS hay_id, needle, CAST((length(text) - length(replace(text, needle, ''))) // length(needle) AS BIGINT) AS n FROM {CROSSED}")
def count_nonoverlap(spark, sf_dir):
    return _crossed(_hays(spark, sf_dir)).select("hay_id", "needle", search.count("text", F.col("needle")).alias("n"))


@query(f"SELECT doc_id AS hay_id, n.needle, count(i) AS n FROM {CROSSED} LEFT JOIN {STARTS} s ON s.hay_id = doc_id AND s.needle = n.needle GROUP BY doc_id, n.needle")
def count_overlap(spark, sf_dir):
    return _crossed(_hays(spark, sf_dir)).select("hay_id", "needle", search.count("text", F.col("needle"), True).alias("n"))


_SPLIT = f"""SELECT hay_id, needle, CAST(sum(length(part)) OVER (PARTITION BY hay_id, needle ORDER BY pos ROWS UNBOUNDED PRECEDING) + pos * length(needle) AS BIGINT) AS off
FROM (SELECT hay_id, needle, part, pos, max(pos) OVER (PARTITION BY hay_id, needle) AS last FROM (
  SELECT doc_id AS hay_id, needle, unnest(string_split(text, needle)) AS part, unnest(range(0, len(string_split(text, needle)))) AS pos FROM {CROSSED}))
WHERE pos < last"""


@query(_SPLIT)
def find_all_nonoverlap(spark, sf_dir):
    return listing.find_all_rows(_hays(spark, sf_dir), list(NEEDLES))


@query(f"SELECT hay_id, needle, off FROM ({_SPLIT}) QUALIFY row_number() OVER (PARTITION BY hay_id, needle ORDER BY off) <= 3")
def find_all_capped(spark, sf_dir):
    """At most three occurrences of each needle in a text: the cap is the operator's own parameter."""
    return listing.find_all_rows(_hays(spark, sf_dir), list(NEEDLES), cap=3)


@query(f"SELECT hay_id, needle, i AS off FROM {STARTS}")
def find_all_overlap(spark, sf_dir):
    return listing.find_all_rows(_hays(spark, sf_dir), list(NEEDLES), overlap=True)


@query("SELECT conv_id, turn, CAST(len(string_split(text, 'the')) - 1 AS BIGINT) AS n, CAST(instr(text, 'the') - 1 AS BIGINT) AS first FROM conversations")
def find_all_arrays(spark, sf_dir):
    """Lists of offsets as arrays, of short texts."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = search.find_all("text", "the")
    return rows.select("conv_id", "turn", F.size(found).cast("long").alias("n"), F.when(F.size(found) > 0, found[0]).otherwise(-1).cast("long").alias("first"))


@query("SELECT doc_id AS hay_id, CAST(CASE WHEN length(text) >= 64 THEN 1 ELSE 0 END AS INTEGER) AS use_find, CAST(1 AS INTEGER) AS use_batch FROM documents")
def should_use(spark, sf_dir):
    return _hays(spark, sf_dir).select("hay_id", search.should_use(F.length("text"), "find").alias("use_find"), search.should_use(F.length("text"), "has").alias("use_batch"))


# many needles


_FREQUENCY = f"SELECT needle, count(*) AS docs FROM documents JOIN {WORDS} ON contains(text, needle) GROUP BY needle"


@query(_FREQUENCY)
def has_batch_frequency(spark, sf_dir):
    """In how many documents each benchmark word occurs."""
    return batch.totals(_hays(spark, sf_dir), _words(spark, sf_dir)).select("needle", F.col("hays").alias("docs"))


@query(f"SELECT needle, count(*) AS hays, CAST(sum((length(text) - length(replace(text, needle, ''))) // length(needle)) AS BIGINT) AS n FROM documents JOIN {WORDS} ON contains(text, needle) GROUP BY needle")
def count_totals(spark, sf_dir):
    """In how many documents each benchmark word occurs, and how often, summed inside the scan."""
    return batch.totals(_hays(spark, sf_dir), _words(spark, sf_dir))


@query(f"SELECT doc_id AS hay_id, needle FROM documents JOIN {WORDS} ON contains(text, needle)")
def has_batch_pairs(spark, sf_dir):
    return batch.has_pairs(_hays(spark, sf_dir), _words(spark, sf_dir))


@query(f"SELECT doc_id AS hay_id, needle FROM {CROSSED} WHERE contains(text, needle)")
def has_batch_join(spark, sf_dir):
    needles = spark.createDataFrame([(n,) for n in NEEDLES], "needle string")
    return batch.has_pairs(_hays(spark, sf_dir), needles, "join")


@query("SELECT doc_id AS hay_id, " + ", ".join(f"contains(text, '{n}') AS b{i}" for i, n in enumerate(LISTED)) + " FROM documents")
def has_bits(spark, sf_dir):
    bits = batch.has_bits(_hays(spark, sf_dir), list(LISTED))
    return bits.select("hay_id", *[F.col("bits")[i].alias(f"b{i}") for i in range(len(LISTED))])


@query(f"SELECT needle FROM {WORDS} w WHERE EXISTS (SELECT 1 FROM documents WHERE contains(text, needle))")
def has_semi(spark, sf_dir):
    return batch.has_semi(_hays(spark, sf_dir), _words(spark, sf_dir))


@query(f"SELECT doc_id AS hay_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM {SQL_NEEDLES} WHERE contains(text, needle))")
def has_anti(spark, sf_dir):
    needles = spark.createDataFrame([(n,) for n in NEEDLES], "needle string")
    return batch.has_anti(_hays(spark, sf_dir), needles)


@query(f"SELECT doc_id AS hay_id, needle, CAST((length(text) - length(replace(text, needle, ''))) // length(needle) AS BIGINT) AS n FROM documents JOIN {WORDS} ON contains(text, needle)")
def count_batch(spark, sf_dir):
    return batch.count_pairs(_hays(spark, sf_dir), _words(spark, sf_dir))


@query(f"SELECT hay_id, needle, count(*) AS n FROM {STARTS} GROUP BY hay_id, needle")
def count_batch_overlap(spark, sf_dir):
    needles = spark.createDataFrame([(n,) for n in NEEDLES], "needle string")
    return batch.count_pairs(_hays(spark, sf_dir), needles, True, "scan")


@query("SELECT doc_id AS hay_id, " + ", ".join(f"CAST((length(text) - length(replace(text, '{n}', ''))) // {len(n)} AS BIGINT) AS c{i}" if n else f"CAST(0 AS BIGINT) AS c{i}" for i, n in enumerate(LISTED)) + " FROM documents")
def count_list(spark, sf_dir):
    counts = batch.count_list(_hays(spark, sf_dir), list(LISTED))
    return counts.select("hay_id", *[F.col("counts")[i].alias(f"c{i}") for i in range(len(LISTED))])


@query("SELECT p_partkey AS hay_id, needle FROM part CROSS JOIN (VALUES ('a'),('1'),('Part'),('#')) n(needle) WHERE contains(p_name, needle)")
def has_batch_short_texts(spark, sf_dir):
    needles = spark.createDataFrame([("a",), ("1",), ("Part",), ("#",)], "needle string")
    return batch.has_pairs(_hays(spark, sf_dir, "part", "p_partkey", "p_name"), needles)


# profiles


_BYTES = "(SELECT doc_id AS hay_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents)"
_HISTOGRAM = "(SELECT doc_id AS hay_id, unnest(regexp_extract_all(substr(hex(encode(text)), 1, 262144), '..')) AS byte FROM documents)"
_ENTROPY = f"""SELECT doc_id AS hay_id, CAST(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN n > 0 THEN abs(round(log2(n) - s / n, 6)) ELSE 0.0::DOUBLE END AS entropy
FROM documents LEFT JOIN (SELECT hay_id, sum(c) AS n, sum(c * log2(c)) AS s FROM (SELECT hay_id, byte, count(*) AS c FROM {_HISTOGRAM} GROUP BY ALL) GROUP BY hay_id) ON hay_id = doc_id"""


@query(f"SELECT hay_id, string_agg(DISTINCT byte, ' ' ORDER BY byte) AS bytes FROM {_BYTES} GROUP BY hay_id")
def profile_presence(spark, sf_dir):
    return profile.presence(_hays(spark, sf_dir)).where(F.size("bytes") > 0).select("hay_id", F.array_join("bytes", " ").alias("bytes"))


@query(f"SELECT hay_id, byte, count(*) AS n FROM {_HISTOGRAM} GROUP BY ALL")
def profile_histogram(spark, sf_dir):
    return profile.histogram(_hays(spark, sf_dir))


@query(_ENTROPY)
def profile_entropy(spark, sf_dir):
    return profile.entropy(_hays(spark, sf_dir))


@query(f"SELECT hay_id, CASE WHEN entropy <= 3.5 THEN 'high' WHEN entropy <= 5.5 THEN 'mixed' ELSE 'low' END AS label FROM ({_ENTROPY.replace('abs(round(log2(n) - s / n, 6))', 'log2(n) - s / n')})")
def profile_label(spark, sf_dir):
    return profile.label(_hays(spark, sf_dir))


@query("SELECT doc_id AS hay_id, len(list_filter(['C3','A9','7A'], lambda b: NOT list_contains(regexp_extract_all(hex(encode(text)), '..'), b))) = 0 AS may FROM documents")
def may_contain(spark, sf_dir):
    return profile.may_contain(_hays(spark, sf_dir), "éz")


_BLOCKS = "(SELECT page_id AS hay_id, unnest(range(0, (greatest(length(h), 2) - 2) // 16384 + 1)) AS block, h FROM (SELECT page_id, hex(encode(html)) AS h FROM pages))"


@query(f"""SELECT hay_id, CAST(block AS INTEGER) AS block, CASE WHEN e <= 3.5 THEN 'high' WHEN e <= 5.5 THEN 'mixed' ELSE 'low' END AS label FROM (
  SELECT hay_id, block, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM (
    SELECT hay_id, block, byte, count(*) AS c FROM (SELECT hay_id, block, unnest(regexp_extract_all(substr(h, block * 16384 + 1, 8192), '..')) AS byte FROM {_BLOCKS}) GROUP BY ALL)
  GROUP BY hay_id, block)""")
def block_entropy_label(spark, sf_dir):
    return profile.block_labels(_hays(spark, sf_dir, "pages", "page_id", "html"))


_TRIGRAMS = """(SELECT * FROM (SELECT hay_id, n, CAST(i // 8192 AS INTEGER) AS block, b || lead(b) OVER w || lead(b, 2) OVER w AS gram FROM (
  SELECT doc_id AS hay_id, strlen(text) AS n, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b, unnest(range(0, strlen(text))) AS i FROM documents WHERE strlen(text) >= 4096)
  WINDOW w AS (PARTITION BY hay_id ORDER BY i)) WHERE gram IS NOT NULL)"""


@query(f"""SELECT doc_id AS hay_id, CAST(strlen(text) AS BIGINT) AS n, CAST(coalesce(p.bytes, 0) AS BIGINT) AS bytes, CASE WHEN coalesce(e.entropy, 0) <= 3.5 THEN 'high' WHEN e.entropy <= 5.5 THEN 'mixed' ELSE 'low' END AS label,
CASE WHEN strlen(text) >= 4096 THEN CAST((strlen(text) + 8191) // 8192 AS INTEGER) END AS blocks, CAST(g.grams AS BIGINT) AS grams
FROM documents LEFT JOIN (SELECT hay_id, count(DISTINCT byte) AS bytes FROM {_BYTES} GROUP BY hay_id) p ON p.hay_id = doc_id
LEFT JOIN (SELECT hay_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM (SELECT hay_id, byte, count(*) AS c FROM {_HISTOGRAM} GROUP BY ALL) GROUP BY hay_id) e ON e.hay_id = doc_id
LEFT JOIN (SELECT hay_id, count(*) AS grams FROM (SELECT DISTINCT hay_id, block, gram FROM {_TRIGRAMS}) GROUP BY hay_id) g ON g.hay_id = doc_id""")
def profile_build(spark, sf_dir):
    """Whole profiles, a row a document."""
    grams = F.aggregate("grams", F.lit(0).cast("long"), lambda acc, g: acc + F.size(g["grams"]))
    return profile.build(_hays(spark, sf_dir), 2).select(
        "hay_id", "n", F.size("presence").cast("long").alias("bytes"), "label", F.when(F.col("grams").isNotNull(), F.size("grams")).alias("blocks"), grams.alias("grams")
    )


@query(f"SELECT hay_id, block, count(DISTINCT gram) AS grams FROM {_TRIGRAMS} GROUP BY ALL")
def profile_block_grams(spark, sf_dir):
    rows = profile.build(_hays(spark, sf_dir), 2).select("hay_id", F.explode("grams").alias("g"))
    return rows.select("hay_id", F.col("g.block").alias("block"), F.size("g.grams").cast("long").alias("grams")).where("grams > 0")


_WANTED = [b"ation"[i : i + 3].hex().upper() for i in range(3)]


@query(f"""SELECT hay_id, string_agg(CAST(block AS VARCHAR), ' ' ORDER BY block) AS blocks FROM (
  SELECT b.hay_id, b.block, b.blocks FROM (SELECT hay_id, blocks, unnest(range(0, blocks)) AS block FROM (SELECT DISTINCT hay_id, (n + 8191) // 8192 AS blocks FROM {_TRIGRAMS})) b
  JOIN (SELECT DISTINCT hay_id, block, gram FROM {_TRIGRAMS} WHERE gram IN ({", ".join(f"'{g}'" for g in _WANTED)})) g ON g.hay_id = b.hay_id AND (g.block = b.block OR g.block = b.block + 1)
  GROUP BY ALL HAVING count(DISTINCT gram) = {len(_WANTED)} AND count(*) FILTER (g.block = b.block AND gram = '{_WANTED[0]}') > 0) GROUP BY hay_id, blocks HAVING count(*) <= blocks // 2 + 1""")
def profile_candidates(spark, sf_dir):
    """Blocks in which a needle may begin, from kept profiles alone."""
    found = profile.profiled_blocks(profile.build(_hays(spark, sf_dir), 2), "ation").where(F.size("blocks") > 0)
    return found.select("hay_id", F.array_join(F.transform("blocks", lambda b: b.cast("string")), " ").alias("blocks"))


@query(f"SELECT hay_id, CAST(block AS INTEGER) AS block FROM {_BLOCKS} WHERE contains(substr(h, block * 16384 + 1, 16384 + 2 * 8), hex(encode('</article'))) AND regexp_matches(substr(h, block * 16384 + 1, 16384 + 16), '^(..)*' || hex(encode('</article')))")
def candidate_blocks(spark, sf_dir):
    return profile.candidate_blocks(_hays(spark, sf_dir, "pages", "page_id", "html"), "</article")


# store


@query("SELECT min(doc_id) AS handle, text, count(*) AS refs FROM documents GROUP BY text")
def intern_dedup(spark, sf_dir):
    return store.intern(_hays(spark, sf_dir))


@query("""SELECT handle, text, refs - coalesce(gone, 0) AS refs FROM (SELECT min(doc_id) AS handle, text, count(*) AS refs FROM documents GROUP BY text)
LEFT JOIN (SELECT doc_id, count(*) AS gone FROM labels WHERE quality = 0 GROUP BY doc_id) ON doc_id = handle WHERE refs > coalesce(gone, 0)""")
def release(spark, sf_dir):
    gone = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").select(F.col("doc_id").alias("handle"))
    return store.release(store.intern(_hays(spark, sf_dir)), gone)


@query("SELECT doc_id AS hay_id, CAST(instr(text, 'tion') - 1 AS BIGINT) AS off FROM documents")
def memo_find(spark, sf_dir):
    return store.memo_find(_hays(spark, sf_dir), "tion")


@query("SELECT doc_id AS hay_id, CAST((length(text) - length(replace(text, 'tion', ''))) // 4 AS BIGINT) AS n FROM documents")
def memo_count(spark, sf_dir):
    return store.memo_count(_hays(spark, sf_dir), "tion")


@query("SELECT doc_id AS hay_id, contains(text, 'idiot') AS b0, contains(text, 'tion') AS b1 FROM documents")
def memo_has_batch(spark, sf_dir):
    return store.memo(_hays(spark, sf_dir), b0=search.has("text", "idiot"), b1=search.has("text", "tion"))


@query("SELECT min(doc_id) AS handle, text, count(*) AS refs FROM documents GROUP BY text")
def store_snapshot(spark, sf_dir):
    """The store written as a snapshot and read back."""
    path = staging.new_path(spark, "store")
    store.save(store.intern(_hays(spark, sf_dir)), path)
    return store.load(spark, path)


@query("""SELECT handle, needle, CAST(instr(text, needle) - 1 AS BIGINT) AS off, CAST((length(text) - length(replace(text, needle, ''))) // length(needle) AS BIGINT) AS n
FROM (SELECT min(doc_id) AS handle, text FROM documents GROUP BY text) CROSS JOIN (VALUES ('the'), ('tion'), ('é')) x(needle)""")
def memo_table(spark, sf_dir):
    """Answers kept from one needle, read back, and completed for others."""
    contents, path = store.intern(_hays(spark, sf_dir)), staging.new_path(spark, "memo")
    store.save(store.remember(contents, ["the"]), path)
    return store.remember(contents, ["the", "tion", "é"], path)


@query("SELECT doc_id AS hay_id, min(doc_id) OVER (PARTITION BY text) AS handle FROM documents")
def store_handles(spark, sf_dir):
    return store.handles(_hays(spark, sf_dir))


@query("SELECT count(*) AS objects, CAST(sum(refs) AS BIGINT) AS refs, CAST(sum(refs * b) AS BIGINT) AS raw_bytes, CAST(sum(b) AS BIGINT) AS resident_bytes FROM (SELECT text, strlen(text) AS b, count(*) AS refs FROM conversations GROUP BY text)")
def store_stats(spark, sf_dir):
    return store.stats(_hays(spark, sf_dir, "conversations", "conv_id"))


@query("SELECT doc_id AS hay_id, substr(hex(encode(text)), 201, 200) AS bytes FROM documents")
def read_range(spark, sf_dir):
    return store.read_range(_hays(spark, sf_dir), 100, 100).select("hay_id", F.hex("bytes").alias("bytes"))


# repeats


_WINDOWS = "(SELECT doc_id AS hay_id, text, substr(text, i + 1, 16) AS sub FROM (SELECT doc_id, text, unnest(range(0, length(text) - 15, 16)) AS i FROM documents WHERE length(text) >= 16))"


@query(f"SELECT sub, count(*) AS n, count(DISTINCT hay_id) AS hays FROM {_WINDOWS} GROUP BY sub HAVING count(*) >= 2")
def repeats_corpus(spark, sf_dir):
    return repeats.corpus_windows(_hays(spark, sf_dir))


@query(f"SELECT hay_id, sub, count(*) AS n FROM {_WINDOWS} GROUP BY hay_id, sub HAVING count(*) >= 2")
def repeats_per_document(spark, sf_dir):
    return repeats.hay_windows(_hays(spark, sf_dir))


@query(f"""SELECT hay_id, sub, CAST(16 AS BIGINT) AS len, n, 16 + t - n * 10 AS est_lin, row_number() OVER (PARTITION BY hay_id ORDER BY 16 + t - n * 10, n DESC, sub) AS place
FROM (SELECT hay_id, sub, length(any_value(text)) AS t, CAST((length(any_value(text)) - length(replace(any_value(text), sub, ''))) // 16 AS BIGINT) AS n FROM {_WINDOWS} GROUP BY hay_id, sub HAVING count(*) >= 2)
WHERE n >= 2 QUALIFY place <= 8""")
def repeats_scored(spark, sf_dir):
    return repeats.scored(_hays(spark, sf_dir))


@query("SELECT sub, count(*) AS n FROM (SELECT substr(text, i + 1, 3) AS sub FROM (SELECT text, unnest(range(0, length(text) - 2, 8)) AS i FROM documents WHERE length(text) >= 3)) WHERE sub NOT IN ('   ', chr(10) || chr(10) || chr(10)) GROUP BY sub HAVING count(*) BETWEEN 2 AND 64")
def rare_grams(spark, sf_dir):
    return repeats.rare_grams(_hays(spark, sf_dir))


@query("""SELECT chunk, count(*) AS n, count(DISTINCT hay_id) AS hays FROM (SELECT hay_id, substr(h, i * 512 + 1, 512) AS chunk FROM (
  SELECT doc_id AS hay_id, hex(encode(text)) AS h, unnest(range(0, strlen(text) // 256)) AS i FROM documents)) GROUP BY chunk HAVING count(*) > 1""")
def fixed_twins(spark, sf_dir):
    return chunking.twins(chunking.fixed_chunks(_hays(spark, sf_dir), 256)).select(F.hex("chunk").alias("chunk"), "n", "hays")


@query("SELECT sub, count(*) AS n FROM (SELECT substr(text, i + 1, 3) AS sub FROM (SELECT text, unnest(range(0, length(text) - 2)) AS i FROM documents WHERE length(text) >= 3)) WHERE sub NOT IN ('   ', chr(10) || chr(10) || chr(10)) GROUP BY sub HAVING count(*) BETWEEN 2 AND 64")
def rare_grams_dense(spark, sf_dir):
    """The same at every position."""
    return repeats.rare_grams(_hays(spark, sf_dir), stride=1)


@query()
def suffix_repeats(spark, sf_dir):
    """The longest repeated substring of every document: suffix order, tested against brute force; SQL needs all suffixes as rows."""
    return repeats.longest(_hays(spark, sf_dir))


@query("""SELECT hay_id, CASE WHEN max(common) >= 4 THEN max(common) ELSE 0 END AS len FROM (
  SELECT hay_id, coalesce(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: substr(a, k, 1) <> substr(b, k, 1))[1] - 1, least(length(a), length(b)), 0) AS common
  FROM (SELECT hay_id, a, lag(a) OVER (PARTITION BY hay_id ORDER BY a) AS b FROM (SELECT item_id AS hay_id, substr(text, i + 1) AS a FROM (SELECT item_id, text, unnest(range(0, length(text))) AS i FROM benchmark))) WHERE b IS NOT NULL
) GROUP BY hay_id""")
def suffix_repeats_short(spark, sf_dir):
    """The same of every benchmark item, where SQL can sort the suffixes."""
    return repeats.longest(_hays(spark, sf_dir, "benchmark", "item_id"))


@query()
def repeats_budgeted(spark, sf_dir):
    """Ranked repeats of single documents, from all LCP intervals; tested against all substrings of small texts."""
    return repeats.repeats(_hays(spark, sf_dir))


@query()
def repeats_in(spark, sf_dir):
    """The same, searched once a distinct content."""
    return store.repeats_in(_hays(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id AS hay_id, text, length(text) AS n, regexp_extract_all(text, '(?s).') AS cs FROM documents),
w AS (SELECT hay_id, substr(text, i + 1, 16) AS win, i FROM (SELECT hay_id, text, unnest(range(0, n - 15, 16)) AS i FROM d WHERE n >= 16)),
p AS (SELECT hay_id, list(i ORDER BY i)[1] AS a, list(i ORDER BY i)[2] AS b FROM w GROUP BY hay_id, win HAVING count(*) >= 2),
x AS (SELECT hay_id, text, n, a, b, coalesce(list_filter(range(1, a + 1), lambda k: cs[a - k + 1] <> cs[b - k + 1])[1] - 1, a) AS l,
        coalesce(list_filter(range(16, least(n - b, 272)), lambda k: cs[a + k + 1] <> cs[b + k + 1])[1], least(n - b, 272)) AS r FROM p JOIN d USING (hay_id)),
s AS (SELECT DISTINCT hay_id, text, n AS t, substr(text, a - l + 1, CASE WHEN short THEN 5 ELSE least(256, l + r) END) AS sub FROM x CROSS JOIN (VALUES (true), (false)) v(short)),
c AS (SELECT hay_id, sub, t, CAST(instr(text, sub) - 1 AS BIGINT) AS off, CAST(length(sub) AS INTEGER) AS len, CAST((t - length(replace(text, sub, ''))) // length(sub) AS BIGINT) AS n FROM s),
e AS (SELECT hay_id, off, len, n, CAST(len + t - n * (len - (4 + CASE WHEN len >= 10 THEN 2 ELSE 0 END + CASE WHEN len >= 100 THEN 1 ELSE 0 END)) AS BIGINT) AS est_lin, sub FROM c WHERE n >= 2)
SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY hay_id ORDER BY est_lin, len DESC, n DESC, sub) <= 24""")
def repeats_extended(spark, sf_dir):
    """Repeated windows of each document, extended beyond their grid."""
    return repeats.extended(_hays(spark, sf_dir))


@query()
def repeats_seeded(spark, sf_dir):
    """Repeats from short seeds; tested against a plain version."""
    return repeats.seeded(_hays(spark, sf_dir))


@query()
def repeats_twins(spark, sf_dir):
    """Repeats that twin chunks of each document grow to, small fixed chunks among them; tested on planted passages."""
    return repeats.twins(_hays(spark, sf_dir), Options(max_len=16_384), (4096, 1024, 256, 64))


# chunks


def _cut_sql(table: str, key: str, text: str) -> str:
    """Chunks by the byte-by-byte rule: only the last 12 bytes reach the hash's low bits, and an end follows the end before."""
    low = ", ".join(f"('{b:02X}', {int(v) % 4096})" for b, v in enumerate(chunking.gear()))
    hashed = " + ".join(f"{1 << k} * coalesce(lag(v, {k}) OVER w, 0)" if k else "v" for k in range(chunking.BITS))
    upto = f"least(coalesce(list_filter(e, lambda x: x >= {{0}} + {chunking.LEAST})[1], n), {{0}} + {chunking.MOST}, n)"
    return f"""(WITH RECURSIVE g(x, v) AS (VALUES {low}), d AS (SELECT {key} AS hay_id, hex(encode({text})) AS h, CAST(strlen({text}) AS BIGINT) AS n FROM {table} WHERE {text} <> ''),
b AS (SELECT hay_id, i, v FROM (SELECT hay_id, unnest(regexp_extract_all(h, '..')) AS x, unnest(range(0, n)) AS i FROM d) JOIN g USING (x)),
ends AS (SELECT hay_id, list(i + 1 ORDER BY i) AS e FROM (SELECT hay_id, i, ({hashed}) % 4096 AS low FROM b WINDOW w AS (PARTITION BY hay_id ORDER BY i)) WHERE low = 0 GROUP BY hay_id),
t AS (SELECT d.hay_id, h, n, coalesce(e, []) AS e FROM d LEFT JOIN ends ON ends.hay_id = d.hay_id),
c AS (SELECT hay_id, 0 AS seq, CAST(0 AS BIGINT) AS off, {upto.format(0)} AS upto FROM t
  UNION ALL SELECT c.hay_id, seq + 1, upto, {upto.format("c.upto")} FROM c JOIN t ON t.hay_id = c.hay_id WHERE c.upto < n)
SELECT c.hay_id, CAST(seq AS INTEGER) AS seq, off, substr(h, 2 * off + 1, 2 * (upto - off)) AS chunk FROM c JOIN t ON t.hay_id = c.hay_id)"""


_CHUNKS = _cut_sql("documents", "doc_id", "text")


@query(f"SELECT hay_id, seq, off, md5(chunk) AS digest FROM {_cut_sql('pages', 'page_id', 'html')}")
def cdc_chunks(spark, sf_dir):
    return chunking.chunks(_hays(spark, sf_dir, "pages", "page_id", "html")).select("hay_id", "seq", "off", F.md5(F.hex("chunk")).alias("digest"))


@query(f"SELECT md5(chunk) AS digest, count(*) AS n, count(DISTINCT hay_id) AS hays FROM {_CHUNKS} GROUP BY chunk HAVING count(*) > 1")
def cdc_twins(spark, sf_dir):
    return chunking.twins(chunking.chunks(_hays(spark, sf_dir))).select(F.md5(F.hex("chunk")).alias("digest"), "n", "hays")


@query(f"SELECT CAST(sum(n) AS BIGINT) AS chunks, count(*) AS distinct_chunks, CAST(sum(n * b) AS BIGINT) AS raw_bytes, CAST(sum(b) AS BIGINT) AS resident_bytes FROM (SELECT count(*) AS n, length(chunk) // 2 AS b FROM {_CHUNKS} GROUP BY chunk)")
def chunk_dedup_stats(spark, sf_dir):
    return chunking.dedup_stats(chunking.chunks(_hays(spark, sf_dir)))


@query("SELECT doc_id AS hay_id, md5(text) AS digest FROM documents WHERE text <> ''")
def chunk_assembly(spark, sf_dir):
    """Documents put together again from their chunks."""
    return chunking.assemble(chunking.chunks(_hays(spark, sf_dir))).select("hay_id", F.md5("bytes").alias("digest"))


@query("SELECT doc_id AS hay_id, substr(hex(encode(text)), 3001, 400) AS bytes FROM documents WHERE strlen(text) > 1500")
def chunk_range(spark, sf_dir):
    return chunking.read_chunks(chunking.chunks(_hays(spark, sf_dir)), 1500, 200).select("hay_id", F.hex("bytes").alias("bytes"))


@query(f"SELECT first.hay_id AS chunk_hay, first.seq AS chunk_seq, digest, refs FROM (SELECT min(row(hay_id, seq)::STRUCT(hay_id BIGINT, seq INTEGER)) AS first, md5(chunk) AS digest, count(*) AS refs FROM {_CHUNKS} GROUP BY chunk)")
def chunk_table(spark, sf_dir):
    """The distinct chunks and their references."""
    return chunking.chunk_table(chunking.chunks(_hays(spark, sf_dir))).select("chunk_hay", "chunk_seq", F.md5(F.hex("chunk")).alias("digest"), "refs")


@query(f"SELECT hay_id, count(*) AS chunks, CAST(sum(length(chunk) // 2) AS BIGINT) AS bytes, md5(string_agg(md5(unhex(chunk)), '' ORDER BY seq)) AS digest FROM {_CHUNKS} GROUP BY hay_id")
def object_table(spark, sf_dir):
    return chunking.object_table(chunking.chunks(_hays(spark, sf_dir)))


@query("SELECT doc_id AS hay_id, CAST(instr(text, 'idiot') - 1 AS BIGINT) AS off, CAST((length(text) - length(replace(text, 'idiot', ''))) // 5 AS BIGINT) AS n FROM documents")
def find_profiled(spark, sf_dir):
    return profile.find_profiled(_hays(spark, sf_dir), "idiot")


@query("""SELECT doc_id AS hay_id, CAST(instr(text, 'tion') - 1 AS BIGINT) AS off, CAST(CASE WHEN instr(text, 'é') = 0 THEN -1 ELSE strlen(substr(text, 1, instr(text, 'é') - 1)) END AS BIGINT) AS bytes,
contains(text, 'aa') AS has, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n, CASE WHEN contains(text, 'zz') THEN CAST(instr(text, 'zz') - 1 AS BIGINT) END AS position FROM documents""")
def sql_functions(spark, sf_dir):
    """The searches called by name from SQL text."""
    sql_forms.register(spark)
    hays = _hays(spark, sf_dir)
    return spark.sql(
        "SELECT hay_id, needle_find(text, 'tion') AS off, needle_find_bytes(text, 'é') AS bytes, needle_has(text, 'aa') AS has, needle_count(text, 'the') AS n, "
        "needle_position(text, 'zz') AS position FROM {hays}",
        hays=hays,
    )


@query("SELECT doc_id AS hay_id, CASE WHEN contains(text, 'zz') THEN CAST(instr(text, 'zz') - 1 AS BIGINT) END AS position, CAST(1 AS INTEGER) AS empty_places FROM documents")
def script_forms(spark, sf_dir):
    rows = _hays(spark, sf_dir)
    return rows.select("hay_id", sql_forms.position("text", "zz").alias("position"), F.size(sql_forms.positions("text", "")).alias("empty_places"))


@query()
def repeats_map(spark, sf_dir):
    return sql_forms.repeats_map(_hays(spark, sf_dir))


@query("SELECT event_type, count(*) AS events, CAST(sum((length(props) - length(replace(props, '1', '')))) AS BIGINT) AS ones FROM events WHERE contains(props, '1') GROUP BY event_type")
def events_search(spark, sf_dir):
    """Search in a filter and in an aggregate."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where(search.has("props", "1"))
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.sum(search.count("props", "1")).alias("ones"))
