import random

import pytest
from pyspark.sql import functions as F

from arborform.llm.decontaminate import MIN_CHARS, Items, fold_table, hits, rolling, without_hits
from arborform.llm.texts import code_points

TABLE = fold_table()


def fold(t):
    return "".join(map(chr, TABLE[code_points([t])[0]]))


def best(item, text):
    """Smallest edit distance of the item to any part of the text (plain table)."""
    row = list(range(len(item) + 1))
    low = row[-1]
    for c in text:
        new = [0]
        for j, x in enumerate(item):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != c)))
        row = new
        low = min(low, row[-1])
    return low


def corpus(seed):
    rnd = random.Random(seed)
    words = ["the", "of", "that", "ering", "thand", "is", "ou", "esten", "ation", "reheat", "to", "a"]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    items = [(i, text(rnd.randint(6, 40))) for i in range(8)]
    docs = []
    for d in range(60):
        body = text(rnd.randint(0, 80))
        if d % 2:
            i, t = rnd.choice(items)
            t = list(t)
            for _ in range(int(len(t) * rnd.choice([0, 0.02, 0.05, 0.09, 0.14]))):
                p = rnd.randrange(len(t))
                t[p:p + 1] = rnd.choice([[], ["x"], [t[p], "y"]])
            p = rnd.randrange(len(body) + 1)
            body = body[:p] + "\n" + "".join(t).upper() + "\t" + body[p:]
        docs.append((d, body))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs, items = corpus(seed)
    want = {}
    for d, t in docs:
        for i, x in items:
            n = best(fold(x), fold(t))
            if n <= int(0.1 * len(x)):
                want[d, i] = n
    out = hits(spark.createDataFrame(docs, "k bigint, t string").repartition(3), "k", "t",
               spark.createDataFrame(items, "i bigint, x string"), "i", "x").collect()
    got = {(r["key"], r["item"]): r["edits"] for r in out}
    assert set(got) <= set(want) and all(got[p] >= want[p] for p in got)
    assert len(got) >= 0.98 * len(want)
    exact = {p for p in want if want[p] == 0}
    assert exact <= set(got) and all(got[p] == 0 for p in exact)
    by = dict(items)
    for r in out:
        if r["edits"] == 0:
            assert fold(dict(docs)[r["key"]][r["start"]:r["end"]]) == fold(by[r["item"]])


def test_rolling_hash_by_doubling():
    c, _ = code_points(["abcdefghijabcdefghij"])
    for q in range(1, 11):
        h = rolling(c, q)
        assert len(h) == 20 - q + 1 and h[0] == h[10] and (q == 1 or h[0] != h[1])


def test_edge_cases(spark):
    item = "a passage of the benchmark that is long enough"
    rows = [(1, None), (2, ""), (3, item), (3, item), (None, "x " + item.upper()), (4, "y " * 60_000 + item), (5, "clean text " * 20), (6, item[:-1])]
    df = spark.createDataFrame(rows, "key bigint, text string").withColumn("item", F.lit("clash"))
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "x" * (MIN_CHARS - 1))], "key bigint, text string")
    got = sorted((r["key"] or -1, r["item"], r["edits"]) for r in hits(df, "key", "text", items, "key", "text").collect())
    assert got == sorted((k, i, e) for k, e in ((3, 0), (3, 0), (-1, 0), (4, 0), (6, 1)) for i in (1, 2))
    kept = without_hits(df, "text", items, "key", "text")
    assert kept.columns == df.columns and sorted(r["key"] for r in kept.collect()) == [1, 2, 5]


def test_short_items_are_searched_exactly(spark):
    """At word boundaries, folded like the texts; not with an edit, not inside a word."""
    items = spark.createDataFrame([(1, "Who is it?"), (2, "42"), (3, "  who\tis it? "), (4, " \n"), (5, "long enough to be no short item")], "i bigint, x string")
    docs = [(1, "so: WHO  is it?"), (2, "and\nWho is\nit? yes"), (3, "xwho is it?"), (4, "who is it ?"), (5, "a 42."), (6, "142"), (7, "420"), (8, "42"), (9, "who is it?42")]
    df = spark.createDataFrame(docs, "k bigint, t string")
    got = sorted((r["key"], r["item"], r["start"], r["end"], r["edits"]) for r in hits(df, "k", "t", items, "i", "x").collect())
    assert got == [(2, 1, 4, 14, 0), (2, 3, 4, 14, 0), (5, 2, 2, 4, 0), (8, 2, 0, 2, 0), (9, 1, 0, 10, 0), (9, 2, 10, 12, 0), (9, 3, 0, 10, 0)]
    assert sorted(r["k"] for r in without_hits(df, "t", items, "i", "x").collect()) == [1, 3, 4, 6, 7]
    only_short = items.filter("i = 2")
    assert sorted(r["key"] for r in hits(df, "k", "t", only_short, "i", "x").collect()) == [5, 8, 9]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k bigint, t string")
    some = spark.createDataFrame([(1, "some text that is long enough for an item")], "k bigint, t string")
    assert hits(none, "k", "t", some, "k", "t").count() == 0
    assert hits(some, "k", "t", none, "k", "t").count() == 0
    assert without_hits(some, "t", none, "k", "t").count() == 1


def test_item_blocks_give_the_same(spark, monkeypatch):
    from arborform.llm import decontaminate as D
    docs, items = corpus(3)
    d, i = spark.createDataFrame(docs, "k bigint, t string"), spark.createDataFrame(items, "i bigint, x string")
    one = sorted(map(tuple, hits(d, "k", "t", i, "i", "x").collect()))
    plain = D.item_blocks
    monkeypatch.setattr(D, "item_blocks", lambda *a: plain(*a, limit=100))
    assert sorted(map(tuple, hits(d, "k", "t", i, "i", "x").collect())) == one


def test_repetitive_text():
    it = Items([0], ["ab" * 40], TABLE)
    assert it.search(["ab" * 5000]) [0][4] == 0
    assert it.search(["ba" * 20]) == []
