"""List ranking: running sums along linked lists that lie in a table, in any order.

A list is a set of rows (id, next id, weights). Ranking by following pointers
would need as many rounds as the list is long, and pointer doubling moves all
rows in every round. Here independent rows are taken out of the lists instead:

* Contraction. Every id has a pseudo-random number for the round. A row whose
  number is lower than those of its neighbours leaves; its predecessor takes
  over its next id and adds its weights. No two neighbours leave together, and
  about a third of the rows do, so all rounds together move a few times the
  rows of the first. A round is one join on the id (ids are unique, so no key is
  hot) and writes the rows that stay and those that left.
* Base. What is left once a round has at most ``base`` rows is walked in one
  task: a bound, not a share of the input.
* Expansion. Rounds are undone in reverse: a row that left gets its
  predecessor's sums, plus what the predecessor weighed then.

Storage is linear in the rows whatever the shape of the lists. Rows that no head
leads to (cycles, or lists whose start is not a head) get no rank. A lost
executor re-reads the written rounds.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import ship_package_by_value
from ..session import written

BASE = 1 << 18          # rows that one task walks
ROWS_OF = "array<struct<id:bigint,next:bigint,head:boolean,out:boolean,%s>>"


def _number(id_col: str, turn: int):
    """A row's number in a round; the end of a list has the highest."""
    return F.when(F.col(id_col).isNull(), F.lit((1 << 63) - 1)).otherwise(F.xxhash64(id_col, F.lit(turn)))


def _contract(rows: DataFrame, weights: list[str], turn: int) -> DataFrame:
    """One round: every row, with ``out`` where it leaves (then ``next`` is its
    predecessor and the weights are the predecessor's)."""
    h, h_next = _number("id", turn), _number("next", turn)
    # a row that points to a lower number is carried by the row it points to
    points = rows.filter(h_next < h).select(F.col("next").alias("id"), F.struct("id", "head", *weights).alias("p"))
    own = rows.withColumn("carried", h_next < h)
    joined = own.join(points, "id", "left").withColumn("leaves", ~F.col("carried") & F.col("p").isNotNull())
    keep = F.struct("id", "next", "head", F.lit(False).alias("out"), *weights)
    spliced = F.struct(F.col("p.id").alias("id"), F.col("next"), F.col("p.head").alias("head"), F.lit(False).alias("out"),
                       *[(F.col(f"p.{w}") + F.col(w)).alias(w) for w in weights])
    left = F.struct("id", F.col("p.id").alias("next"), F.lit(False).alias("head"), F.lit(True).alias("out"), *[F.col(f"p.{w}").alias(w) for w in weights])
    before = F.struct(F.col("p.id").alias("id"), F.col("id").alias("next"), F.col("p.head").alias("head"), F.lit(False).alias("out"),
                      *[F.col(f"p.{w}").alias(w) for w in weights])
    rows_of = (F.when(F.col("leaves"), F.array(spliced, left))
               .when(F.col("p").isNotNull(), F.array(before))               # carried itself: its own row comes from its next
               .when(~F.col("carried"), F.array(keep)).otherwise(F.array().cast(ROWS_OF % ", ".join(f"{w}:bigint" for w in weights))))
    return joined.select(F.explode(rows_of).alias("r")).select("r.*")


def _walk(rows: DataFrame, weights: list[str]) -> DataFrame:
    """Ranks of at most BASE rows, walked in one task."""
    ship_package_by_value()

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        ids, heads = table.column("id").to_pylist(), table.column("head").to_pylist()
        following, own = table.column("next").to_pylist(), [table.column(w).to_pylist() for w in weights]
        place = {v: i for i, v in enumerate(ids)}
        order, root, sums = [], [], [[] for _ in weights]
        for start in (i for i, h in enumerate(heads) if h):
            i, upto = start, [0] * len(weights)
            while i is not None:
                order.append(ids[i])
                root.append(ids[start])
                for k, w in enumerate(own):
                    sums[k].append(upto[k])
                    upto[k] += w[i]
                i = place.get(following[i])
                if i == start:
                    raise ValueError("a list comes back to its head")
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(root, pa.int64()), *[pa.array(v, pa.int64()) for v in sums]],
                                         names=["id", "root", *weights])
    return rows.coalesce(1).mapInArrow(run, "id bigint, root bigint, " + ", ".join(f"{w} bigint" for w in weights))


def list_rank(rows: DataFrame, weights: list[str], base: int = BASE) -> DataFrame:
    """rows(id, next, head, weights...) -> (id, root, weights...): the head of
    each row's list and, for each weight, its sum over the rows before.

    ``id`` is unique, ``next`` null at a list's end, else the id of a row that no
    other row names as its next; ``head`` marks the rows that lists begin with.
    Rows that no head leads to are not returned.
    """
    rows = rows.select(F.col("id").cast("bigint").alias("id"), F.col("next").cast("bigint").alias("next"), "head", *[F.col(w).cast("bigint").alias(w) for w in weights])
    live, removed, done, turn = written(rows, "lists"), [], [], 0
    while True:
        # a head without a next is a whole list; a row that is its own next, a whole cycle
        whole = live.filter(F.col("head") & F.col("next").isNull())
        done.append(whole.select("id", F.col("id").alias("root"), *[F.lit(0).cast("bigint").alias(w) for w in weights]))
        live = live.filter((~F.col("head") | F.col("next").isNotNull()) & ~F.col("id").eqNullSafe(F.col("next")))
        size = live.agg(F.count(F.lit(1)).alias("n"), F.count("next").alias("open")).first()
        if size["n"] <= base or not size["open"]:
            break
        turn += 1
        both = written(_contract(live, weights, turn), "lists")
        live = both.filter(~F.col("out")).drop("out")
        removed.append(both.filter("out").drop("out", "head"))
    if size["n"] <= base:
        done.append(_walk(live, weights))
    ranks = reduce(DataFrame.unionByName, done)
    for left in reversed(removed):
        known = written(ranks, "ranks")
        before = known.select(F.col("id").alias("next"), "root", *[F.col(w).alias(f"_{w}") for w in weights])
        more = left.join(before, "next").select("id", "root", *[(F.col(w) + F.col(f"_{w}")).alias(w) for w in weights])
        ranks = known.unionByName(more)
    return ranks
