"""URL filter: rules first, then link-graph propagation over hosts.

A rule (host and path prefix) fits its host and all subdomains; of the rules
that fit a url the longest decides. Urls without a rule are judged by their
host: trust spreads from hosts whose pages rules allow along links, distrust
spreads from hosts whose pages rules block against links (who links to a
blocked host is suspect). Both are personalised PageRanks

    rank(h) = (1 - damping) * seed(h) + damping * sum(rank(g) * share(g, h))

where seed is the share of the host's pages that rules allow (or block) and
share(g, h) the share of g's outgoing (for distrust: h's incoming) links. Both
are divided by 1 - damping, so an unlinked host keeps its seed. A host is
blocked if distrust - trust exceeds ``THRESHOLD``; without links or seeds it
is allowed.

Links: absolute and protocol-relative addresses in href and src of the pages'
html; a page counts once for each host it links to; a host's links to itself
don't count.

Nulls, ties and edge cases: a null url, or one without ``://``, has an empty
host and path, fits no rule and is allowed; null html has no links; repeated
rows are judged as often as given; rules of equal length and host differ in
path and can't fit one url; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstats.llm.scratch import sized, stored

#: The rules of the registered query (fixed values): rule, verdict.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
DAMPING, ROUNDS, THRESHOLD = 0.85, 12, 0.5
#: Rounds after which the ranks are written and read again.
WRITE_EVERY = 6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(`_url`, instr(`_url`, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (row, host, path, ...) with ``rule`` and ``ruling``: the
    longest fitting rule and its verdict, else null. Each host's suffixes
    are joined to the rules' hosts."""
    spark = pages.sparkSession
    listed = spark.createDataFrame([(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for r, v in rules], "rule_host string, rule_path string, rule string, ruling string")
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    fits = (pages.select("host").distinct().select("host", F.explode(suffixes).alias("rule_host"))
            .join(F.broadcast(listed), "rule_host")  # the rule list, given by the caller
            .groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "ruling", "rule_path")).alias("rules")))
    best = F.array_max(F.filter("rules", lambda r: F.startswith("path", r["rule_path"])))
    return (pages.join(sized(stored(fits, "fits"), 512), "host", "left")
            .withColumn("_best", best)
            .withColumns({"rule": F.col("_best.rule"), "ruling": F.col("_best.ruling")}).drop("rules", "_best"))


def host_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(a, b, n): on how many pages of host a a link to host b stands."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?i)\b(?:href|src)\s*=\s*[\"']?\s*(?:https?:)?//([^\"'\s>/?#]+)"), F.lit(1))
    targets = F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.translate(x, _UPPER, _LOWER), "^.*@|:[0-9]*$", "")))
    return (pages.select(F.col("host").alias("a"), F.explode(targets).alias("b")).where("a != '' AND b != '' AND a != b")
            .groupBy("a", "b").agg(F.count("*").alias("n")))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, kind, rank) from ``seeds`` (host, kind, seed) over ``edges``
    (kind, a, b, share), divided by 1 - damping; zero ranks are left out."""
    seeds, edges = stored(seeds.where("seed > 0"), "seeds"), stored(edges, "links")
    ranks = seeds.withColumnRenamed("seed", "rank")
    if edges.isEmpty():
        return ranks
    for i in range(rounds):
        moved = (ranks.withColumnRenamed("host", "a").join(edges, ["a", "kind"])
                 .select(F.col("b").alias("host"), "kind", (F.col("rank") * F.col("share") * damping).alias("rank")))
        ranks = moved.unionByName(seeds.withColumnRenamed("seed", "rank")).groupBy("host", "kind").agg(F.sum("rank").alias("rank"))
        if i % WRITE_EVERY == WRITE_EVERY - 1 or i == rounds - 1:
            ranks = stored(ranks, "ranks")
    return ranks


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS,
               id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), trust, distrust."""
    host, path = host_and_path(F.col("_url"))
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("html")).select(
        "page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "html")
    judged = stored(ruled(named.select("page_id", "host", "path"), rules), "ruled")
    links = stored(host_links(named), "links")
    out_of, into = (links.groupBy(c).agg(F.sum("n").alias("all")) for c in ("a", "b"))
    edges = (links.join(out_of, "a").select(F.lit("trust").alias("kind"), "a", "b", (F.col("n") / F.col("all")).alias("share"))
             .unionByName(links.join(into, "b").select(F.lit("distrust").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), (F.col("n") / F.col("all")).alias("share"))))
    share = lambda v: F.avg(F.when(F.col("ruling") == v, 1.0).otherwise(0.0)).alias(v)
    by_host = judged.where("host != ''").groupBy("host").agg(share("allow"), share("block"))
    seeds = by_host.select("host", F.explode(F.create_map(F.lit("trust"), F.col("allow"), F.lit("distrust"), F.col("block"))).alias("kind", "seed"))
    ranks = propagate(seeds, edges, damping, rounds).groupBy("host").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])
    out = judged.join(sized(stored(ranks, "scores"), 96), "host", "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust")})
    verdict = F.coalesce("ruling", F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
