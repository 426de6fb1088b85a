"""Operator 3: URL filter by propagation over the host graph.

Rules decide the urls they fit; every other url gets the verdict of its host.
Hosts are joined by edges: links from one host's pages to another host
(relative links stay on the host) and, weaker, the tie between a subdomain and
its parent domain in both directions. Trust is a personalised PageRank from
the hosts whose urls an allow rule fits, along the edges; distrust is one from
the hosts that a block rule fits, against the edges: whoever links to a bad
host is suspect. A host is blocked when its distrust exceeds ``threshold``
times its trust. What hosts without edges would pass on returns to the seeds, so
both sum to one whole.

Both are iterated in one loop, over rows of (kind, host), until no verdict can
change. What all further steps can still add is bounded by the growth of the
steps before (a step passes on 0.85 of what the one before added), so a host is
decided once that rest, all of it added to one side, changes nothing; hosts
without a score are decided once no step reaches a new host. Hosts whose two
scores stay equal end the loop when the rest is under ``TOLERANCE``.

The loop is as wide as the graph: up to BUCKET_EDGES edges it runs in one
partition, without a shuffle. Beyond, the graph is a table bucketed by (kind,
source), so a step shuffles only the sums per target, added up in each task
before, and nothing is broadcast. A source with very many targets would fill its bucket: such hubs, few by
definition, are kept in a table of their own whose rows are spread evenly, and
only their scores are broadcast.

Scores are integers (units of 1e-15 of the whole), so sums do not depend on the
order in which a shuffle delivers them. Edges are summed per host pair before
any join.

Defined results: a null url, or one without ``://``, has empty host and path and
no rule; the empty host is judged like any other (no edges, no scores: allow);
null html has no links; html of any length is read whole; equal scores (ties)
allow; repeated rows are judged each and their links count each time; columns
called like the added ones (``_host``, ``_verdict``, ...) or like inner ones are
kept beside them; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_subdir
from .common import Scratch, broadcast_under, scratch

# Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LINK = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""
UNIT = 10 ** 15
DAMPING = 0.85
TOLERANCE = UNIT // 10 ** 9
WRITE_STEPS = 6             # steps between two written scores
BUCKET_EDGES = 500_000      # edges of a bucket, about
HUB_EDGES = 1_000_000       # from here on a source is a hub
DOMAIN_TIE = 0.1            # weight of a subdomain tie against the links of the host
THRESHOLD = 1.0
HOST_BYTES = 16 << 20       # largest table of host scores that is broadcast


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):     # a longer rule is asked before a shorter
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def edges(pages: DataFrame) -> DataFrame:
    """pages(host, html) -> src, dst, w: links per pair of hosts, in whole numbers."""
    target = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))
    links = pages.filter("host <> ''").select("host", target.alias("to"))
    dst = F.when(F.col("to").rlike("^(?i)https?://"), host_of(F.col("to"))).when(
        F.col("to").startswith("//"), host_of(F.concat(F.lit("http:"), F.col("to")))).otherwise(F.col("host"))
    return (links.select(F.col("host").alias("src"), dst.alias("dst")).filter("dst <> ''")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


def with_domains(links: DataFrame, hosts: DataFrame, tie: float = DOMAIN_TIE) -> DataFrame:
    """Add the ties of every host to its parent domain and back. A top-level
    name is no parent."""
    up = hosts.union(links.select("dst")).distinct().toDF("host")
    labels = F.size(F.split("host", r"\."))
    chain = up.filter(labels > 2).select("host", F.explode(F.sequence(F.lit(0), labels - 3)).alias("i"))
    part = lambda i: F.array_join(F.slice(F.split("host", r"\."), i + 1, F.size(F.split("host", r"\."))), ".")
    ups = chain.select(part(F.col("i")).alias("src"), part(F.col("i") + 1).alias("dst")).distinct()
    both = ups.union(ups.select("dst", "src"))
    out_links = links.groupBy("src").agg(F.sum("n").alias("all"))
    ties = (both.join(out_links, "src", "left")
            .select("src", "dst", (F.coalesce("all", F.lit(1)) * F.lit(tie)).alias("w")))
    return (links.select("src", "dst", F.col("n").cast("double").alias("w")).union(ties)
            .groupBy("src", "dst").agg(F.sum("w").alias("w")))


def step_of(score: DataFrame, graph: DataFrame, hubs: DataFrame | None, back: DataFrame, damping: float, lay) -> DataFrame:
    """One step for both kinds: score(k, host, score) along the edges, and back to the seeds."""
    def along(edges_, score_):
        return (edges_.join(score_, (F.col("k") == F.col("k2")) & (F.col("src") == F.col("host")))
                .select("k", F.col("dst").alias("host"), F.floor(F.col("score") * F.col("share") * F.lit(damping)).cast("bigint").alias("score")))
    score = score.select(F.col("k").alias("k2"), "host", "score")
    moved = along(graph, score.hint("shuffle_hash"))
    if hubs is not None:
        few = score.join(hubs.select(F.col("k").alias("k2"), F.col("src").alias("host")).distinct().hint("merge"), ["k2", "host"], "left_semi")
        moved = moved.unionByName(along(hubs, F.broadcast(few)))
    return lay(moved.unionByName(back)).groupBy("k", "host").agg(F.sum("score").alias("score"))


def settled(seeds: DataFrame, graph: DataFrame, threshold: float | None = None, damping: float = DAMPING, tolerance: int = TOLERANCE,
            hub_edges: int = HUB_EDGES, bucket_edges: int = BUCKET_EDGES) -> DataFrame:
    """Personalised PageRank of each kind: seeds(k, host, mass), graph(k, src, dst,
    share) -> k, host, score, scaled to sum to the mass of the kind's seeds.

    With ``threshold``, the loop also ends once for every host the comparison of
    its score of kind 1 with ``threshold`` times that of kind 0 is final. Hosts
    without outgoing edges return their damped score to the seeds; that only
    multiplies all scores of a kind by one number, so it is done once, at the end.
    """
    spark = seeds.sparkSession
    table, name = Scratch(spark), "host_edges_" + uuid.uuid4().hex
    seeds, graph = table(seeds, "rank-seeds"), table(graph, "rank-edges")
    total = {r["k"]: r["m"] for r in seeds.groupBy("k").agg(F.sum("mass").alias("m")).collect()}       # one row a kind
    degree = table(graph.groupBy("k", "src").agg(F.count(F.lit(1)).alias("n")), "rank-degrees")
    size = degree.agg(F.sum("n").alias("all"), F.max("n").alias("top")).first()
    hubs, rest = None, graph
    if (size["top"] or 0) > hub_edges:
        # at most all edges / hub_edges sources, so few score rows to broadcast
        big = degree.filter(F.col("n") > hub_edges).select("k", "src")
        hubs, rest = table(graph.join(big.hint("merge"), ["k", "src"]), "rank-hubs"), graph.join(big.hint("merge"), ["k", "src"], "left_anti")
    wide, before = (size["all"] or 0) // bucket_edges + 1, spark.conf.get("spark.sql.shuffle.partitions")
    # one partition: no exchange in a step; else shuffles as wide as the graph has buckets
    lay = (lambda df: df.coalesce(1)) if wide == 1 else (lambda df: df)
    try:
        if wide > 1:
            spark.conf.set("spark.sql.shuffle.partitions", str(wide))
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
            (rest.select("k", "src", "dst", "share").repartition(buckets, "k", "src").write.bucketBy(buckets, "k", "src")
             .option("path", fresh_subdir(spark, "rank-buckets")).saveAsTable(name))
            rest = spark.table(name)
        rest, seeds = lay(rest.select("k", "src", "dst", "share")), lay(seeds)
        back = seeds.select("k", "host", F.floor(F.col("mass") * F.lit(1 - damping)).cast("bigint").alias("score"))
        score, sums, reached, passed = back, {}, -1, damping ** WRITE_STEPS
        while True:
            for _ in range(WRITE_STEPS):
                score = step_of(score, rest, hubs, back, damping, lay)
            score = lay(table(score, "rank-scores"))    # cuts the growing lineage
            now = {r["k"]: (r["m"], r["hosts"]) for r in score.groupBy("k").agg(F.sum("score").alias("m"), F.count(F.when(F.col("score") > 0, 1)).alias("hosts")).collect()}
            # increments shrink by the damping at least: what the growth of the last steps leaves for all later ones
            left = {k: (now[k][0] - sums.get(k, 0)) * passed / (1 - passed) + 1 for k in now}
            sums, closed, reached = {k: m for k, (m, _) in now.items()}, sum(h for _, h in now.values()) == reached, sum(h for _, h in now.values())
            if all(v < tolerance for v in left.values()) or (closed and threshold is not None and not undecided(score, sums, left, threshold)):
                break
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    scale = F.when(F.col("k") == 0, F.lit(total.get(0, 0) / max(1, sums.get(0, 0)))).otherwise(F.lit(total.get(1, 0) / max(1, sums.get(1, 0))))
    out = scratch(score.select("k", "host", F.floor(F.col("score") * scale).cast("bigint").alias("score")), "host-scores")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    table.drop()
    return out


def undecided(score: DataFrame, sums: dict, left: dict, threshold: float) -> int:
    """Hosts whose comparison the mass still to come (``left``, by kind) could change."""
    t, d = (F.coalesce(F.sum(F.when(F.col("k") == k, F.col("score"))), F.lit(0)).cast("double") for k in (0, 1))
    hosts = score.groupBy("host").agg(t.alias("t"), d.alias("d")).filter("t > 0 or d > 0")
    (st, rt), (sd, rd) = ((float(max(1, sums.get(k, 0))), left.get(k, 0.0)) for k in (0, 1))
    block = F.col("d") / (sd + rd) > threshold * (F.col("t") + rt) / st
    allow = (F.col("d") + rd) / sd <= threshold * F.col("t") / (st + rt)
    return hosts.filter(~block & ~allow).count()


def host_scores(pages: DataFrame, threshold: float | None = None) -> DataFrame:
    """pages(host, verdict, html) -> host, trust, distrust (units of UNIT)."""
    hosts = pages.filter("host <> ''").groupBy("host").agg(
        F.count(F.when(F.col("verdict") == "allow", 1)).alias("good"),
        F.count(F.when(F.col("verdict") == "block", 1)).alias("bad"))
    table = Scratch(pages.sparkSession)
    hosts = table(hosts, "hosts")
    graph = table(with_domains(edges(pages), hosts.select("host")), "host-edges")
    sums = hosts.agg(F.sum("good"), F.sum("bad")).first()       # two numbers
    mass = lambda c, all_: F.floor(F.col(c) / F.lit(all_ or 1) * F.lit(float(UNIT))).cast("bigint")
    seeds = (hosts.select(F.explode(F.array(F.struct(F.lit(0).alias("k"), "host", mass("good", sums[0]).alias("mass")),
                                            F.struct(F.lit(1).alias("k"), "host", mass("bad", sums[1]).alias("mass")))).alias("s")).select("s.*").filter("mass > 0"))
    both = graph.select(F.explode(F.array(F.struct(F.lit(0).alias("k"), "src", "dst", "w"), F.struct(F.lit(1).alias("k"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))).alias("e")).select("e.*")
    out_w = both.groupBy("k", "src").agg(F.sum("w").alias("all"))
    score = settled(seeds, both.join(out_w, ["k", "src"]).select("k", "src", "dst", (F.col("w") / F.col("all")).alias("share")), threshold)
    table.drop()
    of = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("score"))), F.lit(0)).cast("bigint")
    return score.groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust"))


def judge(df: DataFrame, url: str, html: str, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """All rows with ``_host``, ``_path``, ``_rule``, ``_verdict``, ``_trust``, ``_distrust``."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != html]).alias("_row"),
                     F.col(html).alias("html"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("hit", fitting_rule(F.col("host"), F.col("path"), rules))
    scores = host_scores(rows.select("host", F.col("hit.verdict").alias("verdict"), "html"), threshold)
    scores = scratch(scores, "host-scores").select(F.col("host").alias("h2"), "trust", "distrust")
    held = scores.agg(F.sum(F.octet_length("h2") + 48)).first()[0] or 0     # bytes of the table, about
    out = rows.join(broadcast_under(scores, held, HOST_BYTES), F.col("host") == F.col("h2"), "left")
    bad = F.coalesce("distrust", F.lit(0)) > F.coalesce("trust", F.lit(0)) * F.lit(float(threshold))
    return out.select("_row.*", F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("hit.rule").alias("_rule"),
                      F.coalesce("hit.verdict", F.when(bad, "block").otherwise("allow")).alias("_verdict"),
                      F.coalesce("trust", F.lit(0)).alias("_trust"), F.coalesce("distrust", F.lit(0)).alias("_distrust"))
