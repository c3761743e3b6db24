"""Verdicts on urls: listed rules first, else trust and distrust carried over the links between hosts.

Personalised PageRank spreads trust from hosts with allowed urls along links, and distrust from hosts
with blocked urls against the direction of links (who links to a blocked host is less to be trusted). A host
is blocked where its distrust is above `margin` times its trust; a host that neither reaches is allowed.

Edges are pre-aggregated to one row for each pair of hosts before anything else, so a host with a third of
all pages is as many edges as it has distinct neighbours. Rank vectors are small beside pages; their
lineage is cut by a checkpoint every few rounds, where it is also tested whether they have settled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules: (verdict, host, path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts, by the links of the pages that name a host, with a scheme or as //host; pages and links without a host count for nothing."""
    links = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), 1)).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))  # only the host is looked at
    return links.select("src", host_of(to).alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float = 1e-6, cut: int = 4) -> DataFrame:
    """Personalised PageRank (host, rank) along edges (src, dst, links) from seeds (host, rank).

    Rounds go on until no host's rank changes by more than `tolerance` of itself; a host that is reached for the first time changes
    by all of it. So neither the number of seeds nor the distance to them decides which hosts have a rank.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("all"))
    share = settle(edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("all")).alias("share")))
    base = seeds.select("host", (F.col("rank") * (1 - damping)).alias("rank"))
    rank = seeds
    while True:
        for _ in range(cut):
            before = rank
            moved = rank.join(share, rank.host == share.src).groupBy("dst").agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("rank"))
            rank = moved.select(F.col("dst").alias("host"), "rank").unionByName(base).groupBy("host").agg(F.sum("rank").alias("rank")).filter("rank > 0")
        # Ranks of both ends of the last round, cut from their lineage at once.
        both = settle(rank.withColumn("was", F.lit(0.0)).unionByName(before.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("was"))).groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")))
        rank = both.filter("rank > 0").select("host", "rank")
        if both.filter(F.abs(F.col("rank") - F.col("was")) > tolerance * F.greatest("rank", "was")).isEmpty():
            return rank


def digits(x: Column, n: int = 12) -> Column:
    """x to n digits from its first on, so that sums in another order give the same value however small it is."""
    return F.format_string(f"%.{n - 1}e", x).cast("double")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url", html: str = "html", damping: float = 0.85, margin: float = 1.0, tolerance: float = 1e-6) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each page.

    Null urls and urls without :// have an empty host and path; they fit no rule and are allowed. Null
    html has no links. Repeated rows stay rows of their own, and count as often as links. An empty table gives none. Where no link
    reaches a host, its trust and distrust are the shares of its own pages that rules allow and block, each over all hosts' such shares;
    a host without either is allowed. Other columns are not looked at.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path")).select("page_id", "host", "path", name.alias("rule"), verdict.alias("listed"))
    edges = settle(host_edges(pages, url, html))
    hosts = settle(judged.filter("host <> ''").groupBy("host").agg(F.avg(F.when(F.col("listed") == "allow", 1.0).otherwise(0.0)).alias("good"), F.avg(F.when(F.col("listed") == "block", 1.0).otherwise(0.0)).alias("bad")))

    def seeds(col: str) -> DataFrame:
        some = hosts.filter(F.col(col) > 0)
        total = some.agg(F.sum(col)).first()[0] or 1.0
        return some.select("host", (F.col(col) / total).alias("rank"))

    trust = spread(edges, seeds("good"), damping, tolerance)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    distrust = spread(back, seeds("bad"), damping, tolerance)
    marks = settle(trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full_outer").select("host", digits(F.coalesce("trust", F.lit(0.0))).alias("trust"), digits(F.coalesce("distrust", F.lit(0.0))).alias("distrust")))
    out = judged.join(marks, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    own = F.when(F.col("distrust") > F.lit(margin) * F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", own).alias("verdict"), "trust", "distrust")
