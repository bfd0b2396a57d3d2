"""Host-level quality rules: document statistics, domain failure rates shrunk by a beta prior, verdicts.

Everything is a DataFrame expression; no Python runs on the executors.  A document's statistics
come from one projection over its text (no shuffle); hosts come from one pre-aggregated group-by of
two counters, and the host table (a row a host) joins back to the narrow statistics.

Defined results: null text counts as no words (all zeros, ``base_failed``); very long texts are taken
whole, an array element a word; a null source is a host of its own; repeated rows are judged one by one;
an empty table gives an empty result; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needlework.llm.common import BLANK, WORD, stage
from needlework.plans.layout import spread

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A host is suspect when its shrunk share of failing documents is over the prior's mean by so many of the prior's deviations.
HOST_DEVIATIONS = 0.25
#: Bounds of the prior's weight, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 10_000.0
#: In a suspect host a document needs fewer symbols a word, and fewer duplicate lines, than these.
SOFT_SYMBOLS_PERCENT = 10
SOFT_DUP_LINES = 3


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once: a lambda variable is bound, a column may be inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; hashes: one per window start."""

    def repeated(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        return F.filter(
            F.transform(
                pairs,
                lambda p, k: F.when(
                    (F.when(k > 0, pairs[F.greatest(k - 1, F.lit(0))]["h"] == p["h"]).otherwise(F.lit(False)))
                    | (F.when(k < last, pairs[F.least(k + 1, last)]["h"] == p["h"]).otherwise(F.lit(False))),
                    p["i"],
                ),
            ),
            lambda i: i.isNotNull(),
        )

    def total(starts: Column) -> Column:
        return F.aggregate(
            F.zip_with(
                starts,
                F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.lit(2**30))),
                lambda at, following: F.least(following - at, F.lit(WINDOW)),
            ),
            F.lit(0),
            lambda acc, x: acc + x,
        )

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(pairs, lambda p: _let(F.sort_array(repeated(p)), lambda s: F.when(F.size(s) > 0, total(s)).otherwise(0)))


def _repeat_words(words: Column) -> Column:
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + j] for j in range(WINDOW)])
        )

    def count(h: Column) -> Column:
        return _let(
            windows(h),
            lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w)),
        )

    return F.when(F.size(words) > WINDOW, _let(hashed, count)).otherwise(F.lit(0))


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The five counts of every document, with the columns ``keep``; one projection, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = spread(docs.select(*keep, "text")).select(*keep, text.alias("__text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("__words"))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: F.length(F.translate(x, BLANK, "")) > 0)
    return words.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate("__text", BLANK, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__words")).cast("long").alias("n_repeat_words"),
    )


def _rules() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > SOFT_SYMBOLS_PERCENT * words,
        "lines": F.col("n_dup_lines") > SOFT_DUP_LINES,
    }


def _failed() -> Column:
    rules = _rules()
    return rules["short"] | rules["repeats"] | rules["symbols"] | rules["lines"]


def host_verdicts(stats: DataFrame, host: str = "source") -> DataFrame:
    """(host, n_docs, n_failed, rate, suspect) from (host, failed): failures by host, shrunk by an empirical beta prior.

    The prior's mean m is the share over all documents; its weight s comes from the variance v of
    the hosts' own rates by moments, s = m(1-m)/v - 1, held within LEAST_WEIGHT and MOST_WEIGHT.
    The shrunk rate is (failed + s*m) / (docs + s): a host of few documents stays near m.  The limit
    comes from the same prior, whose deviation is sqrt(m(1-m) / (s+1)), so that it follows the corpus.
    """
    hosts = stats.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    own = F.col("n_failed") / F.col("n_docs")
    m, v = hosts.agg(F.sum("n_failed") / F.sum("n_docs"), F.var_pop(own)).first()  # two numbers
    m = m or 0.0
    s = max(LEAST_WEIGHT, min(MOST_WEIGHT, m * (1 - m) / v - 1)) if v else MOST_WEIGHT
    rate = (F.col("n_failed") + F.lit(s * m)) / (F.col("n_docs") + F.lit(s))
    limit = m + HOST_DEVIATIONS * (m * (1 - m) / (s + 1)) ** 0.5
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate > limit).alias("suspect"))


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source") -> DataFrame:
    """One row per document: the counts, ``base_failed`` and ``kept``.

    A document goes when it fails a base rule (too short, too repetitive), or when its host is
    suspect and it fails a soft rule (symbols, duplicate lines); a clean document of a bad host stays.
    """
    stats = stage(statistics(docs, key, host), "quality-stats")
    judged = stats.withColumn("failed", _failed())
    hosts = stage(host_verdicts(judged, host).where("suspect").select("host", "suspect"), "quality-suspects")  # its size is known then
    rules = _rules()
    met = stats.join(hosts, stats[host].eqNullSafe(hosts["host"]), "left")
    base = rules["short"] | rules["repeats"]
    soft = F.coalesce(F.col("suspect"), F.lit(False)) & (rules["symbols"] | rules["lines"])
    return met.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~soft).alias("kept"),
    )


def keep(docs: DataFrame) -> DataFrame:
    """The documents, all their columns, that the rules keep.

    One pass over the texts: each row is staged with what the rules say of it, without its columns where a base rule
    has it go anyway, so nothing is scanned again and no text meets its verdict by a key that may repeat.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col("text"), F.col("source"))
    rules = _rules()
    base = rules["short"] | rules["repeats"]
    said = statistics(packed, "__row", "source").select(
        "source", _failed().alias("failed"), (rules["symbols"] | rules["lines"]).alias("soft"), F.when(~base, F.col("__row")).alias("__row")
    )
    stats = stage(said, "quality-judged")
    hosts = stage(host_verdicts(stats).where("suspect").select("host", "suspect"), "quality-suspects")  # its size is known then
    met = stats.where("__row is not null").join(hosts, stats["source"].eqNullSafe(hosts["host"]), "left")
    return met.where(~(F.col("soft") & F.coalesce("suspect", F.lit(False)))).select("__row.*")
