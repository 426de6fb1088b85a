"""Operator 1: secret scan with corpus-wide ownership frequency.

Candidates are found row by row. The hash of each candidate value is then
aggregated over the corpus by distinct repositories and distinct owners: a
value that turns up under many owners is a copied example, one that belongs to
a single owner and looks random is live-looking. Base spans always stay; a
wider candidate (a long mixed token that no base pattern covers) becomes a span
of kind ``owned`` only if it is live-looking.

Distinct counts are taken in two steps (value, owner, repository) -> (value,
owner) -> value, so partial aggregation shrinks a value that fills a third of
the rows to one row per task before each shuffle.

Defined results: null text is the empty text (no spans); null owner or
repository counts as one of its own; equal rows get equal results; positions
are code points, end exclusive; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order in which kinds are listed.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12)
ACCESS = (r"AKIA[A-Z0-9]+", 0, 18)
HEX = (r"[0-9a-f]{16,}", 0, 16)     # the runs of [0-9a-f]+ that hold 16 or more
# the method's own wider candidates
WIDE = (r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
KINDS = ("assign", "access", "hex", "owned")

MAX_OWNERS = 1              # a live secret belongs to one owner ...
MAX_REPOS = 3               # ... and to few repositories
MIN_DISTINCT_SHARE = 0.3    # different characters against length, up to 32


def matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Array of (start, end, kind, value) of the leftmost non-overlapping
    matches whose ``group`` has ``least`` code points.

    Spark's extraction gives the matches without places; the pieces between
    them come from a split by the same pattern, and running lengths give the
    places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.split(text, pattern).alias("gap"), found.alias("whole"), value.alias("value"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"),
                    F.array().cast("array<struct<start:bigint,end:bigint,kind:int,value:string>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["whole"]), F.lit(0))
        item = F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"),
                        F.lit(kind).alias("kind"), x["value"].alias("value"))
        keep = x["whole"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct(end.cast("bigint").alias("at"), F.when(keep, F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,value:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(rows, zero, step, lambda a: a["out"])).otherwise(empty)


def base_spans(text: Column) -> Column:
    return F.concat(matches(text, *ASSIGN, 0), matches(text, *ACCESS, 1), matches(text, *HEX, 2))


def looks_random(value: Column) -> Column:
    """Letters and digits mixed (or hex), with many different characters."""
    chars = F.size(F.array_distinct(F.split(value, "")))
    return F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]")) & (
        chars >= F.least(F.length(value), F.lit(32)) * F.lit(MIN_DISTINCT_SHARE))


def scan(df: DataFrame, key: str, text: str, owner: str, repo: str) -> DataFrame:
    """One row per input row: key, id (hash of the text), owner, repo, base and
    wide spans. Wide spans touch no base span."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.xxhash64(t).alias("id"), F.col(owner).cast("string").alias("owner"),
                     F.col(repo).cast("string").alias("repo"), base_spans(t).alias("base"), matches(t, *WIDE, 3).alias("wide"))
    clear = F.filter("wide", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return rows.withColumn("wide", clear)


def ownership(candidates: DataFrame) -> DataFrame:
    """candidates(value_hash, owner, repo) -> value_hash, repos, owners."""
    once = candidates.select("value_hash", "owner", "repo").distinct()
    return (once.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
            .groupBy("value_hash").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners")))


def findings(scanned: DataFrame) -> DataFrame:
    """One row per different candidate span: key, id, start, end, kind,
    value_hash, repos, owners and verdict: ``example`` (widely copied),
    ``live`` (owner-specific and random-looking) or ``unsure``."""
    spans = (scanned.filter("size(base) + size(wide) > 0")
             .select("key", "id", "owner", "repo", F.explode(F.concat("base", "wide")).alias("s"))
             .select("key", "id", "owner", "repo", "s.start", "s.end", "s.kind",
                     F.sha2("s.value", 256).alias("value_hash"), looks_random(F.col("s.value")).alias("random")))
    counts = ownership(spans)
    copied = (F.col("owners") > MAX_OWNERS) | (F.col("repos") > MAX_REPOS)
    # a value in very many rows makes its join key hot: AQE splits the spans' side
    return (spans.join(counts, "value_hash", "left")
            .withColumn("verdict", F.when(copied, "example").when(F.col("random"), "live").otherwise("unsure")))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans by start, then kind as listed."""
    names = F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame, found: DataFrame) -> DataFrame:
    """One row per input row: counts by kind, base and all spans, verdicts."""
    span = F.struct("start", "end", "kind")
    per_row = found.groupBy(F.col("key").alias("k2"), F.col("id").alias("id2")).agg(
        F.collect_set(F.when((F.col("kind") == 3) & (F.col("verdict") == "live"), span)).alias("added"),
        F.countDistinct(F.when((F.col("kind") < 3) & (F.col("verdict") == "live"), span)).alias("n_live"),
        F.countDistinct(F.when((F.col("kind") < 3) & (F.col("verdict") == "example"), span)).alias("n_example"))
    rows = scanned.select("key", "id", "base").join(
        per_row, F.col("key").eqNullSafe(F.col("k2")) & (F.col("id") == F.col("id2")), "left")
    slim = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    kinds = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{KINDS[i]}") for i in range(3)]
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")
    return rows.select("key", *kinds, F.sha2(joined(slim), 256).alias("base_sha256"),
                       joined(F.concat(slim, F.coalesce("added", none))).alias("spans"),
                       F.coalesce("n_live", F.lit(0)).cast("bigint").alias("n_live"),
                       F.coalesce("n_example", F.lit(0)).cast("bigint").alias("n_example"))
