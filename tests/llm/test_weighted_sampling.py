import hashlib
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from arborform.llm import weighted_sampling as W
from arborform.llm.queries import queries


def weights(text):
    c = Counter(re.findall(r"[^\x20\x09-\x0D]+", text.lower()))
    return {w: 1 + math.log(n) for w, n in c.items()}


def jaccard(a, b):
    a, b = weights(a), weights(b)
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def test_collision_rate_is_generalised_jaccard(spark):
    one = " ".join(["the"] * 30 + ["of"] * 9 + [f"a{i}" for i in range(40)])
    two = " ".join(["the"] * 10 + ["of"] * 20 + [f"a{i}" for i in range(25)] + [f"b{i}" for i in range(20)])
    df = spark.createDataFrame([(1, one, two)], "id int, x string, y string")
    got = []
    for base in range(0, 512, 64):                      # 512 independent samples
        old = W.samples
        try:
            W.samples = lambda t, w, k, base=base: old(t, w, base + k)
            r = W.sign(df, ["id"], ["x", "y"], 64).select(W.likeness(F.col("x"), F.col("y"), 64)).first()[0]
        finally:
            W.samples = old
        got.append(r)
    want = jaccard(one, two)
    assert abs(np.mean(got) - want) < 4 * math.sqrt(want * (1 - want) / 512)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (k, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        third = len(t) // 3
        out[k] = (len(t), hashlib.sha256((t[:len(t) - third] + n[:third]).encode()).hexdigest())
    return out


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return queries()["op8_weighted_sampling"](spark, str(tmp_path)).collect()


def test_neighbours_and_edits_over_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "RANGE_ROWS", 7)
    rows = [(i * 3 - 50, None if i % 31 == 0 else f"é𝒳 text {i} " * (i % 9)) for i in range(200)] + [(None, "null key")]
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in run(spark, tmp_path, rows)}
    assert got == brute(rows)


def test_equal_texts_empty_texts_long_and_repeats(spark, tmp_path):
    rows = [(1, "a b c"), (2, "A  b\nc"), (3, None), (4, ""), (5, "word " * 40_000), (6, "a b c"), (6, "a b c"), (7, " \t ")]
    out = run(spark, tmp_path, rows)
    assert len(out) == len(rows)
    fp = {r["doc_id"]: r["fingerprint"] for r in out}
    assert fp[1] == fp[2] == fp[6] != fp[5] and fp[3] == fp[4] == fp[7] == ""
    near = {r["doc_id"]: r for r in out}
    assert near[4]["near_next"] == 1.0 and near[5]["near_next"] == 0.0 and near[2]["near_next"] == 1.0
    assert all(0 <= r["near_edited"] <= 1 for r in out)


def test_one_row_and_no_rows(spark, tmp_path):
    r = run(spark, tmp_path, [(1, "one two three four five six")])
    assert len(r) == 1 and r[0]["near_next"] == 1.0
    assert run(spark, tmp_path / "none", []) == []


def test_likeness_follows_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    order = sorted(docs, reverse=True)
    want, edit = {}, {}
    for i, (k, t) in enumerate(order):
        n = order[(i + 1) % len(order)][1]
        third = len(t) // 3
        want[k], edit[k] = jaccard(t, n), jaccard(t, t[:len(t) - third] + n[:third])
    out = queries()["op8_weighted_sampling"](spark, sf).collect()
    assert abs(np.mean([r["near_next"] - want[r["doc_id"]] for r in out])) < 0.02
    assert abs(np.mean([r["near_edited"] - edit[r["doc_id"]] for r in out])) < 0.03


def test_likeness_in_steps_of_a_32nd_at_most(spark, tmp_path):
    r = run(spark, tmp_path, [(1, " ".join(f"w{i}" for i in range(60))), (2, "other words")])[0]
    assert len(r["fingerprint"]) >= 32 * 16 and len(r["edited_fingerprint"]) == len(r["fingerprint"])
    assert (r["near_edited"] * (len(r["fingerprint"]) // 16)).is_integer()
