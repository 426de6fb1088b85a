"""Operator 8: document fingerprints by consistent weighted sampling.

A text is a weighted set: each lower-cased word with weight 1 + ln(count). For
sample k and term x the hash of (x, k) gives r, c ~ Gamma(2, 1) and b ~ U(0, 1);
with weight w, t = floor(ln w / r + b) and y = exp(r (t - b)) the sample is the
term with the smallest a = c / (y e^r). Two texts agree in one sample with the
probability of their generalised Jaccard similarity. For a given k the value a
is fixed by the pair (x, t), so the smallest ln a itself is the sample: no term
has to be carried along, and a fingerprint is K minima of doubles, which the
hash aggregate keeps in place.

Neighbours: documents are cut into ranges of descending key at sampled
quantiles, each range is ordered by a window of its own, and the first row of
the next range follows the last of this one. Everything about a document then
happens where its range is: texts are shuffled once.

Defined results: null text is the empty text; a text without words has an
empty fingerprint, alike (1.0) to another empty one and to nothing else; null
keys come last; equal keys follow the hash of the text; a table of one row is
its own next; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS

SAMPLES = 32
RANGE_ROWS = 1_000          # documents in a range, about; more beyond MAX_RANGES ranges
MAX_RANGES = 1_000


def samples(term: Column, weight: Column, k: int) -> Column:
    """ln a of sample k for a hashed term (bigint) and its ln weight (double)."""
    # two 64-bit hashes give five uniforms: 24 + 24 + 16 and 32 + 32 bits
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    unit = lambda h, shift, bits: ((F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) + 0.5)
                                   / F.lit(float(1 << bits)))
    r = -F.log(unit(one, 40, 24) * unit(one, 16, 24))
    b = unit(one, 0, 16)
    ln_c = F.log(-F.log(unit(two, 32, 32) * unit(two, 0, 32)))
    t = F.floor(weight / r + b)
    return ln_c - r * (t - b) - r


def weighted(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array of struct(term, lw)."""
    runs = F.sort_array(F.transform(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORDS), F.lit(0)), lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_runs", runs)
    begin = F.expr("filter(sequence(1, size(_runs)), i -> i = 1 or _runs[i - 1] <> _runs[i - 2])")
    rows = rows.withColumn("_at", F.when(F.size("_runs") > 0, begin).otherwise(F.array().cast("array<int>")))
    pairs = F.expr("""transform(_at, (a, i) -> struct(_runs[a - 1] as term,
        ln(1 + ln(cast(coalesce(get(_at, i + 1), size(_runs) + 1) - a as double))) as lw))""")
    return rows.withColumn(out, pairs).drop("_runs", "_at")


def cut_points(df: DataFrame, key: str) -> list:
    """At most MAX_RANGES - 1 key values, descending, that cut the keys evenly."""
    ranges = max(1, min(MAX_RANGES, df.count() // RANGE_ROWS))
    at = [i / ranges for i in range(1, ranges)] or [0.5]
    found = df.agg(F.percentile_approx(key, at, 10 * ranges)).first()[0] or []
    return sorted(set(found), reverse=True)


def in_ranges(df: DataFrame, key: str, text: str, cuts: list) -> DataFrame:
    """Rows (key, text, h, part): part 0 holds the largest keys, the last one nulls."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    above = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    part = F.when(F.col("key").isNull(), F.lit(len(cuts) + 1)).otherwise(
        F.size(F.filter(above, lambda c: c >= F.col("key"))))
    return rows.withColumn("h", F.xxhash64("text")).withColumn("part", part.cast("int"))


def next_part(parts: DataFrame) -> DataFrame:
    """parts(part) -> part, after: the next range that has rows, the first one
    after the last. At most MAX_RANGES + 1 rows."""
    order = Window.orderBy("part")
    every = Window.partitionBy()
    return parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(every)).alias("after"))


def neighbours(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, text, part, rn, nxt): nxt is the text of the next row by
    descending key (then descending text hash), the first one's after the last."""
    rows = in_ranges(df, key, text, cut_points(df, key))
    # the first row of each range, found without its text, then fetched
    first = rows.groupBy("part").agg(F.max(F.struct("key", "h")).alias("top"))
    heads = (rows.join(F.broadcast(first.select(F.col("part").alias("p1"), "top")),      # MAX_RANGES rows
                       (F.col("part") == F.col("p1")) & (F.struct("key", "h").eqNullSafe(F.col("top"))))
             .dropDuplicates(["part"]).select("part", "text"))
    after = next_part(first.select("part"))
    heads = after.join(heads.select(F.col("part").alias("after"), F.col("text").alias("head")), "after") \
        .select(F.col("part").alias("p2"), "head")
    order = Window.partitionBy("part").orderBy(F.col("key").desc_nulls_last(), F.col("h").desc())
    rows = (rows.withColumn("rn", F.row_number().over(order)).withColumn("follow", F.lead("text").over(order)))
    # one text per range joins the last rows; both sides stay where their range is
    rows = rows.join(heads, (F.col("part") == F.col("p2")) & F.col("follow").isNull(), "left")
    return rows.select("key", "text", "part", "rn", F.coalesce("follow", "head").alias("nxt"))


def edit(rows: DataFrame) -> DataFrame:
    """Add edited: the last third of the text replaced by the next text's first characters."""
    third = F.floor(F.length("text") / 3).cast("int")
    return rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third),
                                              F.substring(F.col("nxt"), F.lit(1), third)))


def sign(rows: DataFrame, keep: list[str], texts: list[str], k: int = SAMPLES) -> DataFrame:
    """rows(keep..., texts...) -> keep..., and per text column an array of k
    doubles (empty for a text without words). ``keep`` tells rows apart; if the
    rows lie by one of its columns, nothing is shuffled."""
    each = rows.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(i).alias("which"), F.col(t).alias("text")) for i, t in enumerate(texts)])).alias("x"))
    each = weighted(each.select(*keep, "x.which", "x.text"), "text", "terms").drop("text")
    each = each.select(*keep, "which", F.explode_outer("terms").alias("e")).select(*keep, "which", "e.term", "e.lw")
    low = each.groupBy(*keep, "which").agg(*[F.min(samples(F.col("term"), F.col("lw"), i)).alias(f"s{i}") for i in range(k)])
    arrays = F.when(F.col("s0").isNotNull(), F.array(*[F.col(f"s{i}") for i in range(k)])).otherwise(F.array().cast("array<double>"))
    low = low.select(*keep, "which", arrays.alias("fp"))
    return low.groupBy(*keep).agg(*[F.max(F.when(F.col("which") == i, F.col("fp"))).alias(t) for i, t in enumerate(texts)])


def likeness(a: Column, b: Column, k: int = SAMPLES) -> Column:
    """Share of equal samples; 1 for two empty fingerprints, 0 for one."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v)) / F.lit(float(k))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same)


def as_text(fp: Column) -> Column:
    """16 hexadecimal digits per sample."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(F.xxhash64(x)), 16, "0")), "")


def with_next(signed: DataFrame) -> DataFrame:
    """signed(part, rn, fp, ...) with ``nfp``, the fingerprint of the next row."""
    heads = signed.filter("rn = 1").select(F.col("part").alias("after"), F.col("fp").alias("head"))
    heads = next_part(signed.filter("rn = 1").select("part")).join(heads, "after").select(F.col("part").alias("p2"), "head")
    order = Window.partitionBy("part").orderBy("rn")
    # at most MAX_RANGES + 1 fingerprints
    return (signed.withColumn("follow", F.lead("fp").over(order))
            .join(F.broadcast(heads), F.col("part") == F.col("p2"), "left")
            .withColumn("nfp", F.coalesce("follow", "head")).drop("follow", "head", "p2"))
