"""URL rules and trust propagation over the host graph, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

ALLOW, BLOCK = "allow", "block"
#: The production rules, (verdict, host and path prefix).
RULES = (
    (ALLOW, "org/"),
    (BLOCK, "example.org/es/"),
    (BLOCK, "example.org/en/1"),
    (ALLOW, "com/fr/"),
    (BLOCK, "com/de/"),
)
DAMPING = 0.85
#: Ranks are settled when a step moves this share of all mass or less, and reaches no further host.
TOLERANCE = 1e-9


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without one."""
    return _lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; among equally long ones the longer host wins.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): distinct hosts and how many links of ``pages`` (host, html) go from one to the other."""
    links = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    found = pages.where("host <> '' and html is not null").select(F.col("host").alias("src"), F.explode(links).alias("link"))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    return found.select("src", host_of(target).alias("dst")).where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank) of walks over ``edges`` (src, dst, weight) that restart at ``seeds`` (host, seed), whose seed sums to one.

    A host without outgoing edges restarts. All restarts go to the seeds, so the
    ranks are, up to one factor, the sum over k of the seeds' mass after k steps
    along the edges, each step damped. One join and one aggregation a step, each
    written; steps end when one moves nothing, or ``tolerance`` of all mass or
    less and to no new host. That comes about: mass shrinks by ``damping`` a step
    at least, and every host within reach has a shortest path.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    flow = materialize(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total") * damping).alias("share")), "flow")
    terms = seeds.select("host", F.col("seed").cast("double").alias("mass"))
    if flow.isEmpty():
        return terms.withColumnRenamed("mass", "rank")
    term = terms = materialize(terms, "mass")
    while True:
        moved = term.join(flow, term["host"] == flow["src"]).select(F.col("dst").alias("host"), (F.col("mass") * F.col("share")).alias("mass"))
        term = materialize(moved.groupBy("host").agg(F.sum("mass").alias("mass")), "mass")
        mass = term.agg(F.sum("mass")).first()[0]
        if mass is None or (mass <= tolerance and term.join(terms, "host", "left_anti").isEmpty()):
            break
        terms = materialize(terms.union(term).groupBy("host").agg(F.sum("mass").alias("mass")), "reached")
    total = terms.agg(F.sum("mass")).first()[0] or 1.0
    return terms.select("host", (F.col("mass") / F.lit(total)).alias("rank"))


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = 0.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages`` (page_id, url, html).

    The longest fitting rule decides. Elsewhere the host does: trust is the
    personalised PageRank over links between hosts from the hosts of allowed
    pages, distrust the same over reversed links from the hosts of blocked
    pages, each seed weighted by its number of such pages. A host is blocked if
    distrust passes trust by more than ``threshold``; a host that neither
    reaches is allowed.

    A null url, or one without ``://``, has an empty host and path, no rule and
    no link: allow. Null html has no links. Repeated rows each return and count;
    extra columns are ignored.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    rule, ruled = match_rules(F.col("host"), F.col("path"), rules)
    parsed = materialize(parsed.select("*", rule.alias("rule"), ruled.alias("ruled")), "parsed")
    edges = materialize(host_edges(pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "html")), "edges")
    by_host = materialize(parsed.where("ruled is not null and host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == ALLOW).alias(ALLOW), F.count_if(F.col("ruled") == BLOCK).alias(BLOCK)), "seeds")
    totals = by_host.agg(F.sum(ALLOW).alias(ALLOW), F.sum(BLOCK).alias(BLOCK)).first()
    ranks = {}
    for kind, graph in ((ALLOW, edges), (BLOCK, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))):
        seeds = by_host.where(F.col(kind) > 0).select("host", (F.col(kind) / F.lit(float(totals[kind] or 1))).alias("seed"))
        ranks[kind] = personalised_pagerank(graph, seeds, damping, tolerance)
    scores = ranks[ALLOW].select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).union(ranks[BLOCK].select("host", F.lit(0.0), "rank"))
    scores = materialize(scores.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "scores")
    joined = parsed.join(scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("ruled", F.when(distrust - trust > threshold, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
