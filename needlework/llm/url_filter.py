"""URL rules, and for pages without one a verdict from trust spread over the host graph.

Hosts link when a page of one has an absolute link to another; parallel links add weight.  Trust is a
personalised PageRank from the hosts of allowed pages along the links; distrust is one from the hosts
of blocked pages along the reversed links, for a page that points at bad hosts shares their blame.
Each host is then held against a threshold.  A host that neither reaches is allowed.

Ranks are a row a host; every step is a join with the edges and a pre-aggregated sum, staged now and
then.  Steps go on until no new host is reached and no rank moves by more than ``TOLERANCE`` of all mass, or
until ``STEPS`` of them have spread all but a billionth of it.  Edges of a hub spread over its partners before
they meet its rank: the join is plain, so adaptive execution may split it.

Defined results: a null url, or one without ``://``, has empty host and path and no rule; a null html
has no links; very long pages are searched whole, by one pass of a pattern; repeated rows count again; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needlework.llm.common import drop, only, stage
from needlework.plans.layout import spread as dealt

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path); the longest rule that fits a url decides.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: An anchor's attributes, up to its end or the page's, and the host that a link among them names: each is one pass, however broken the page.
ANCHOR = r"(?i)<a\s([^>]*)(?:>|\z)"
LINK = r"(?i)href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s>]+)"
DAMPING = 0.85
STEPS = 128
STAGE_EVERY = 8
TOLERANCE = 1e-12
#: A host is blocked when its distrust is over this many times its trust.
DISTRUST = 2.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a url; both empty where it has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _fitting(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, written in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last to be wrapped around is tried first
        name, slash, rest = written.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, written).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    host, _ = host_and_path(F.col("url"))
    anchors = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(ANCHOR), F.lit(1))
    found = pages.select(host.alias("src"), F.explode(F.transform(anchors, lambda a: F.regexp_extract(a, LINK, 1))).alias("to")).where("to <> ''")
    links = found.select("src", F.translate("to", UPPER, LOWER).alias("dst")).where("src <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, total: int, value: str) -> DataFrame:
    """(host, value): personalised PageRank along (src, dst, n) from (host, mass), mass counted in shares of ``total``."""
    # hosts are written anew before joins, so that both sides are dealt out for the join and a hub's links may be split
    out = edges.groupBy("src").agg(F.sum("n").alias("total")).select(F.concat("src", F.lit("")).alias("at"), "total")
    moves = stage(edges.join(out, edges["src"] == out["at"]).select("src", "dst", (DAMPING * F.col("n") / F.col("total")).alias("share")), "url-moves")
    start = stage(seeds.where("mass > 0").select("host", ((1 - DAMPING) * F.col("mass") / F.lit(float(total))).alias(value)), "url-seeds")
    if moves.isEmpty():
        return start
    now, before = start, start
    for step in range(1, STEPS + 1):
        ranked = now.select(F.concat("host", F.lit("")).alias("at"), value)
        moved = ranked.join(moves, ranked["at"] == moves["src"]).select(F.col("dst").alias("host"), (F.col(value) * F.col("share")).alias(value))
        now = start.union(moved).groupBy("host").agg(F.sum(value).alias(value))
        if step % STAGE_EVERY == 0:
            now = stage(now, "url-ranks")
            both = now.join(before.select(F.col("host").alias("was"), F.col(value).alias("old")), F.col("host") == F.col("was"), "full")
            new, most = both.agg(F.count_if(F.col("was").isNull()), F.max(F.abs(F.col(value) - F.col("old")))).first()
            if before is not start:
                drop(before)
            if not new and (most or 0.0) <= TOLERANCE:
                break
            before = now
    return now


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page, with its host's trust and distrust."""
    rows = dealt(only(pages, page_id="long", url="string", html="string"))
    host, path = host_and_path(F.col("url"))
    located = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = _fitting(F.col("host"), F.col("path"), rules)
    ruled = stage(located.withColumns({"rule": rule, "said": verdict}), "url-ruled")
    edges = stage(host_edges(rows), "url-edges")
    mass = ruled.where("said is not null and host <> ''").groupBy("host").agg(
        F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad")
    )
    # both ranks share one scale: on a host without links they compare its own pages
    total = mass.agg(F.sum(F.col("good") + F.col("bad"))).first()[0] or 1
    trust = spread(edges, mass.select("host", F.col("good").alias("mass")), total, "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(back, mass.select("host", F.col("bad").alias("mass")), total, "distrust")
    hosts = stage(trust.join(distrust, "host", "full"), "url-hosts")  # its size is known then, and a hot host's pages may be split
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when(d > DISTRUST * t, "block").otherwise("allow")
    return ruled.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), t.alias("trust"), d.alias("distrust")
    )
