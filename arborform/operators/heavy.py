"""The most frequent tokens without shuffling every different one.

A vocabulary needs the exact counts of its V tokens only, but counting by key
shuffles each different token of each task, most of which are rare. Here:

1. Every task keeps a summary of at most ``counters`` tokens. When it grows
   beyond twice that, the count of the first token too many is taken off all, and
   what falls to zero goes (a mergeable frequent-items summary). A token's true
   count lies between its summed counters and that plus E, the sum of all that
   tasks have taken off; a token in no summary has at most E.
2. If E is below the V-th largest sum of counters, every token of the vocabulary
   is among those whose sum plus E reaches it: the candidates. Otherwise, or with
   too many candidates to send to the tasks, the summaries are made anew with four
   times the counters.
3. One more pass counts the candidates exactly; they are broadcast, their number
   is bounded, and only they are shuffled.

So the result is exact, ties included. Where even ``most`` counters prove nothing
(nearly all tokens equally rare), ``None`` says that a plain count has to do.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import ship_package_by_value
from ..session import written

COUNTERS = 8            # counters of a task for each token asked for
LEAST_COUNTERS = 1 << 14
MOST_COUNTERS = 1 << 20
CANDIDATES = 1 << 19    # tokens sent to every task


def pruned(counts: dict, counters: int) -> tuple[dict, int]:
    """At most ``counters`` tokens, less the count of the first one too many, and that count."""
    if len(counts) <= counters:
        return counts, 0
    off = sorted(counts.values(), reverse=True)[counters]
    return {t: n - off for t, n in counts.items() if n > off}, off


def summaries(tokens: DataFrame, col: str, counters: int) -> DataFrame:
    """(token, n) of every task's summary, and one row (null, E) with what it took off."""
    ship_package_by_value()

    def run(batches):
        counts, error = {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = pc.value_counts(batch.column(0)).flatten()
            for t, n in zip(seen[0].to_pylist(), seen[1].to_pylist()):
                if t is not None:
                    counts[t] = counts.get(t, 0) + n
            if len(counts) > 2 * counters:
                counts, off = pruned(counts, counters)
                error += off
        counts, off = pruned(counts, counters)
        keys, values = list(counts) + [None], list(counts.values()) + [error + off]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.int64())], names=["token", "n"])
    return tokens.select(F.col(col).alias("token")).mapInArrow(run, "token string, n bigint")


def frequent(tokens: DataFrame, size: int, col: str = "token", counters: int | None = None, most: int = MOST_COUNTERS,
             candidates: int = CANDIDATES) -> DataFrame | None:
    """Exact (token, n) of a set of tokens that holds the ``size`` most frequent
    ones, all ties at the last count included; null tokens do not count.
    ``tokens`` is read twice, or more if the first summaries prove too little."""
    counters = counters or max(LEAST_COUNTERS, COUNTERS * size)
    while counters <= most:
        sums = written(summaries(tokens, col, counters).groupBy("token").agg(F.sum("n").alias("n")), "heavy")
        error = sums.filter("token is null").agg(F.sum("n")).first()[0] or 0
        known = sums.filter("token is not null and n > 0")
        last = known.orderBy(F.desc("n")).limit(size).agg(F.min("n"), F.count(F.lit(1))).first()    # top-k: ``size`` rows a task
        enough = last[1] == size
        if error == 0 and not enough:
            return known                        # nothing was taken off: the summaries are the counts
        if enough and error < last[0]:
            some = known.filter(F.col("n") + error >= last[0])
            if error == 0:
                return some
            if some.count() <= candidates:
                side = F.broadcast(some.select(F.col("token").alias("_t")))         # ``candidates`` rows at most
                return (tokens.select(F.col(col).alias("token")).join(side, F.col("token") == F.col("_t")).groupBy("token")
                        .agg(F.count(F.lit(1)).alias("n")))
        counters *= 4
    return None
