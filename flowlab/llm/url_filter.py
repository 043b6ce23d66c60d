"""URL filter: rule lists, and trust and distrust propagated over the host graph.

Edges run from the host of a page to the hosts its links name. Trusted seeds
send personalised PageRank along the edges; blocked seeds send distrust
against them (a host that links to a blocked host is suspect). Both runs go in
one table with a direction column, and each step is one join and one grouped
sum over host edges, which never hold more than one row per pair of hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.common import ascii_lower, cut_lineage, table
from flowlab.session import broadcast_if_small

# Rules (host and path prefix -> verdict), as given.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
DAMPING = 0.85
STEPS = 20
HUB_EDGES = 100_000  # edges of a host that meet its score in one task
SEED_SHARE = 0.5  # a host is a seed when at least this share of its pages fits rules of one verdict
BLOCK_RATIO = 0.5  # a host is blocked when distrust is above this share of trust + distrust
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lowered; empty for null or no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits: its host or a subdomain, and a path that starts with its path; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest is tried first: it is added last
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def ruling(rule: Column, rules: dict[str, str]) -> Column:
    """The verdict of a rule; null without one."""
    out = F.lit(None).cast("string")
    for name, verdict in rules.items():
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def ruled_links(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(src, dst, url, ruled, n): links between hosts, by target url (a hash), with the verdict of the rule that fits it.

    Absolute and scheme-relative links of the whole html count.
    """
    links = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1))
    one = (pages.select(url_host(F.col("url")).alias("src"), F.explode(links).alias("link"))
           .select("src", F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")).alias("link"))
           .select("src", url_host(F.col("link")).alias("dst"), url_path(F.col("link")).alias("path")))
    one = one.where("src <> '' and dst <> '' and src <> dst").withColumn("ruled", ruling(fitting_rule(F.col("dst"), F.col("path"), rules), rules))
    return one.groupBy("src", "dst", F.xxhash64("path").alias("url"), "ruled").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """Personalised PageRank in both directions.

    ``edges`` (src, dst, n), ``seeds`` (host, trust, distrust) with 0/1 flags.
    Returns (host, trust, distrust): scores in units of one seed's restart
    mass, so the threshold does not depend on the number of seeds. Mass at a
    host without outgoing edges leaves the walk. Stops early once a step
    changes nothing (no edges), else after ``steps`` steps; every fifth step
    is checkpointed.
    """
    ways = edges.select(F.lit("trust").alias("way"), "src", "dst", "n").union(
        edges.select(F.lit("distrust"), "dst", "src", "n"))
    out = ways.groupBy("way", "src").agg(F.sum("n").alias("total"), F.ceil(F.count("*") / HUB_EDGES).cast("long").alias("parts"))
    # the edges of a hub are dealt to parts by their other end; its score meets each part
    walk = cut_lineage(ways.join(out, ["way", "src"]).select(
        "way", "src", "dst", (F.col("n") / F.col("total")).alias("p"), F.pmod(F.xxhash64("dst"), F.col("parts")).alias("part")))
    hubs = broadcast_if_small(out.where("parts > 1").select("way", "src", "parts"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)).alias("part")
    start = cut_lineage(seeds.select("host", F.explode(F.array(
        F.struct(F.lit("trust").alias("way"), F.col("trust").cast("double").alias("s")),
        F.struct(F.lit("distrust").alias("way"), F.col("distrust").cast("double").alias("s")))).alias("x"))
        .select("host", "x.way", "x.s").where("s > 0"))
    rank = start
    if not walk.isEmpty():
        for step in range(1, steps + 1):
            dealt = rank.withColumnRenamed("host", "src").join(hubs, ["way", "src"], "left").select("way", "src", "s", part)
            moved = (dealt.join(walk, ["way", "src", "part"])
                     .select(F.col("dst").alias("host"), "way", (F.col("s") * F.col("p") * damping).alias("s")))
            rank = (moved.unionByName(start)
                    .groupBy("host", "way").agg(F.sum("s").alias("s")))
            rank = cut_lineage(rank) if step % 5 == 0 else rank
    score = lambda way: F.sum(F.when(F.col("way") == way, F.col("s")).otherwise(0.0)).alias(way)
    return rank.groupBy("host").agg(score("trust"), score("distrust"))


def filter_urls(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Judges every page: (page_id, host, path, rule, verdict, trust, distrust), one row per row of ``pages``.

    The longest fitting rule decides; else the host's scores do: block when
    distrust exceeds ``BLOCK_RATIO`` of both scores together, allow otherwise.
    A host that only links name is a seed by its distinct linked urls, as a
    crawled one is by its pages. Hosts without any score, the empty host included (null or malformed urls),
    are allowed and score 0. Null html has no links. Repeated rows count each.
    Other columns are ignored.
    """
    judged = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = judged.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("ruled", ruling(F.col("rule"), rules))
    share = lambda v: (F.count_if(F.col("ruled") == v) >= SEED_SHARE * F.count("*")).cast("int")
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    links = cut_lineage(ruled_links(pages, rules))
    linked = links.select(F.col("dst").alias("host"), "url", "ruled").distinct().groupBy("host").agg(
        share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = seeds.unionByName(linked.join(seeds, "host", "left_anti"))  # hosts without pages are judged by their linked urls
    scores = propagate(links.groupBy("src", "dst").agg(F.sum("n").alias("n")), seeds)
    scored = judged.join(broadcast_if_small(scores), "host", "left")  # one row per scored host; a hot host stays spread
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(d > BLOCK_RATIO * (t + d), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"),
                         F.round(t, 9).alias("trust"), F.round(d, 9).alias("distrust"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page url: rule lists first, link-graph trust and distrust of the host else."""
    return filter_urls(table(spark, sf_dir, "pages"))
