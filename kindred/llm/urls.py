"""URL filtering: rules on host and path, and link-graph propagation for hosts that no rule decides.

A rule is `host/path`: it fits its host and all subdomains, for urls whose path starts with the rule's; of those
that fit, the longest wins. Elsewhere the verdict is the host's. Hosts of which over half the pages are blocked by
rules are blocked seeds; other hosts with an allowed page are trusted seeds. Edges run between hosts that link to
each other (absolute and protocol-relative href targets; a link within a host is none). Trust is a personalised
PageRank from the trusted seeds along the links; distrust is one from the blocked seeds against the links. What
hosts without links on lose would go back to the seeds, which only scales the ranks, so each kind is divided by its
sum instead. A host is blocked if its distrust exceeds its trust, else allowed; without links there is nothing to
propagate and hosts without seeds are allowed.

Both ranks take a fixed number of rounds of one join and one pre-aggregated sum over the distinct host edges, for
both directions at once; every few rounds the ranks are written to the shared folder.

Rows: a null url, or one without `://`, has an empty host and path, which no rule fits, and is allowed. Null html
has no links. Repeated rows are each judged. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm import shared as S

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\shref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, else null."""
    text = verdict = None
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        text = F.when(fits, rule) if text is None else text.when(fits, rule)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) between different hosts; pages has host and html."""
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    links = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    return links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where(F.col("src") != F.col("dst")).distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int, damping: float, every: int = 5) -> DataFrame:
    """(host, kind, rank): for each kind of seed (host, kind, mass), rank = (1 - damping) * mass + damping * what
    arrives. Kind 'trust' flows from src to dst, 'distrust' from dst to src. Not normalised: hosts that link
    nowhere pass nothing on."""
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b")))
    degree = both.groupBy("kind", "a").agg(F.count("*").alias("degree"))
    flows = S.stage_table(both.join(degree, ["kind", "a"]), "links")
    start = seeds.select("kind", "host", ((1 - damping) * F.col("mass")).alias("rank"))
    rank = start
    for i in range(rounds):
        arrived = flows.join(rank.withColumnRenamed("host", "a"), ["kind", "a"]).select("kind", F.col("b").alias("host"), (damping * F.col("rank") / F.col("degree")).alias("rank"))
        rank = start.unionByName(arrived).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if i % every == every - 1 and i < rounds - 1:
            rank = S.stage_table(rank, "links")
    return rank


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], page_id: str = "page_id", url: str = "url", html: str = "html", rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict."""
    base = pages.select(pages[page_id].alias("page_id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"), pages[html].cast("string").alias("html"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = base.withColumn("rule", rule).withColumn("by_rule", verdict)
    edges = S.stage_table(host_edges(base), "links")
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "block").alias("blocked"), F.count_if(F.col("by_rule") == "allow").alias("allowed"))
    kind = F.when(2 * F.col("blocked") > F.col("n"), "distrust").when(F.col("allowed") > 0, "trust")
    marked = hosts.where(F.col("host") != "").select("host", kind.alias("kind")).where(F.col("kind").isNotNull())
    sizes = marked.groupBy("kind").agg(F.count("*").alias("of"))
    seeds = S.stage_table(marked.join(F.broadcast(sizes), "kind").select("host", "kind", (1.0 / F.col("of")).alias("mass")), "links")
    edges_empty = edges.isEmpty()
    rank = seeds.select("kind", "host", F.col("mass").alias("rank")) if edges_empty else propagate(edges, seeds, rounds, damping)
    if not edges_empty:
        rank = S.stage_table(rank, "links")
    whole = rank.groupBy("kind").agg(F.sum("rank").alias("all"))
    rank = rank.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("rank") / F.col("all")).alias("rank"))
    total = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))
    bad = S.stage_table(total.where(F.round("distrust", 12) > F.round("trust", 12)).select(F.col("host").alias("bad_host")), "links")
    out = judged.drop("html").join(bad, F.col("host") == F.col("bad_host"), "left")
    by_host = F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"))
