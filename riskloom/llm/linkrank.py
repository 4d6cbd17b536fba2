"""URL filter: rules first, then trust and distrust that links carry between hosts.

A url that a rule fits gets the verdict of the longest such rule. For the others the host decides:
trust starts at hosts with allowed pages and follows the links (personalised PageRank), distrust
starts at hosts with blocked pages and follows the links backwards, to who points at them; a host
whose share of distrust in the sum of both exceeds the threshold is blocked. Links are absolute
references to another host in a page's html, summed per pair of hosts before they are shuffled on,
so that a host with many pages is one row per partner. Ranks are sums over joins; their lineage is
cut by a written table every few rounds, until between two such tables the ranks of both kinds change
by less than the tolerance in sum and no host is reached for the first time. What is then missing of
each host's rank is less than the tolerance; a host has a rank however far from the seeds it is.

Defined results: a null url, or one without ://, has an empty host and path, no rule and the verdict
allow; hosts that no seed reaches are allowed; repeated rows each get their verdict; null html has
no links, html of any length is read whole; an empty table gives an empty result; columns besides page_id,
url and html play no part and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import dropped, lower_az, staged

#: (verdict, host and path)
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


@dataclass(frozen=True)
class Walk:
    """tolerance: the change at which following links ends; damping: the share of a host's rank that it hands on each round."""

    tolerance: float = 1e-9
    damping: float = 0.85
    threshold: float = 0.5
    cut_every: int = 5


def host(url: Column) -> Column:
    """What follows the first ://, up to /, ?, # or the end, A-Z lower-cased."""
    return lower_az(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, its verdict) of the columns host and path; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tested first
        name, _, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(a, b, w): how often pages of host a refer to another host b."""
    found = F.regexp_extract_all("html", F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*((?:https?:)?//[^\s\"'>]+)"), F.lit(1))
    refs = pages.select(host(F.col("url")).alias("a"), F.explode(found).alias("ref"))
    refs = refs.select("a", host(F.when(F.col("ref").startswith("//"), F.concat(F.lit("x:"), "ref")).otherwise(F.col("ref"))).alias("b"))
    return refs.filter("a <> '' and b <> '' and a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))


def ranks(seeds: DataFrame, links: DataFrame, walk: Walk) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) and links (a, b, w); each sums to 1."""
    kinds = F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("a").alias("a"), F.col("b").alias("b")),
        F.struct(F.lit("distrust").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b")),
    )
    steps = links.select("w", F.explode(kinds).alias("s")).select("s.kind", "s.a", "s.b", "w")
    out = steps.groupBy("kind", "a").agg(F.sum("w").alias("out"))
    steps = staged(steps.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("w") / F.col("out")).alias("share")), "linkrank-steps")
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("r")) for k in ("trust", "distrust")]))
    start = seeds.select(F.col("host").alias("a"), both.alias("s")).select("a", "s.kind", "s.r").filter("r > 0")
    whole = start.groupBy("kind").agg(F.sum("r").alias("whole"))
    start = staged(start.join(F.broadcast(whole), "kind").select("kind", "a", (F.col("r") / F.col("whole")).alias("r")), "linkrank-seeds")
    rank = start
    reached = rank.count()
    follow = not steps.isEmpty()
    while follow:
        before = rank
        for _ in range(walk.cut_every):
            moved = rank.join(steps, ["kind", "a"]).groupBy("kind", F.col("b").alias("a")).agg((F.sum(F.col("r") * F.col("share")) * walk.damping).alias("r"))
            rank = moved.unionByName(start.withColumn("r", F.col("r") * (1 - walk.damping))).groupBy("kind", "a").agg(F.sum("r").alias("r"))
        rank = staged(rank, "linkrank-ranks")
        moves = rank.unionByName(before.withColumn("r", -F.col("r"))).groupBy("kind", "a").agg(F.sum("r").alias("r"))
        change = moves.agg(F.coalesce(F.sum(F.abs("r")), F.lit(0.0))).first()[0]
        if before is not start:
            dropped(before)
        reached, last = rank.count(), reached
        follow = change >= walk.tolerance or reached > last
    total = rank.groupBy("kind").agg(F.sum("r").alias("total"))  # two rows
    rank = rank.join(F.broadcast(total), "kind").withColumn("r", F.col("r") / F.col("total"))
    value = lambda k: F.sum(F.when(F.col("kind") == k, F.col("r")).otherwise(0.0)).alias(k)
    return rank.groupBy(F.col("a").alias("host")).agg(value("trust"), value("distrust"))


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, walk: Walk | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of page_id, url, html."""
    walk = walk or Walk()
    rule, verdict = rule_of(rules)
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule).withColumn("said", verdict)
    count = lambda said: F.count(F.when(F.col("said") == said, 1))
    seeds = rows.filter("said is not null").groupBy("host").agg(count("allow").alias("trust"), count("block").alias("distrust"))
    scores = ranks(seeds, staged(host_links(pages), "linkrank-links"), walk)
    bad = scores.filter(F.col("distrust") > walk.threshold * (F.col("trust") + F.col("distrust"))).select("host", F.lit("block").alias("told"))
    return rows.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", "told", F.lit("allow")).alias("verdict"))
