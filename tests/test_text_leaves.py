import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborform.functions.arrays import int_text
from arborform.operators import sequence as seq
from arborform.operators.trees import (TOKEN_PATTERN, TextLeaves, byte_blocks, layout_leaf_array, layout_token_counts,
                                       word_characters)
from arborform.operators.vocab import build_vocab

CHARS = ["a", "b1", "_", " ", "  ", "\t", "\n", "\n\n", "\r", "\f", "\x0b", "\x00", "\x01", "+", "==", "é", "ß", "—", "…", " ", " ",
         "中", "文", "٣", "½", "́", "€", "\U0001f600", "\U00020000", "\U0001d7d8", "퟿", "", "�", "\U0010ffff"]


def _texts():
    rnd = random.Random(5)
    return ["", None, "\n", " ", "a", "+", "\n\na", "a\n", "x = 1 + y\n\n \t\nz"] + [
        "".join(rnd.choice(CHARS) for _ in range(rnd.randint(0, 40))) for _ in range(200)]


def _frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(_texts())], "doc_id long, text string")


def test_leaves_over_bytes_are_those_of_the_walk(spark):
    df = _frame(spark)
    want = {r.doc_id: [tuple(x) for x in r.a] for r in df.select("doc_id", layout_leaf_array(F.col("text")).alias("a")).collect()}
    texts = [t or "" for t in _texts()]
    leaves = TextLeaves(pa.array(["not read", *texts]).slice(1), word_characters(spark))
    every = leaves.depth > -1
    got = list(zip(leaves.tokens(every).to_pylist(), leaves.depth.tolist(), leaves.sib.tolist()))
    ends = leaves.count.cumsum().tolist()
    assert {i: got[a:b] for i, (a, b) in enumerate(zip([0] + ends, ends))} == want
    odd = every & (leaves.sib % 2 == 1)
    assert leaves.tokens(odd).to_pylist() == [x[0] for x in got if x[2] % 2 == 1]


def test_word_characters_are_letters_and_digits(spark):
    ranges = word_characters(spark)
    in_one = lambda c: any(a <= ord(c) <= b for a, b in ranges)
    for c in set("".join(CHARS)):
        assert in_one(c) == (c == "_" or unicodedata.category(c)[0] in "LN"), hex(ord(c))


def test_token_counts_make_the_same_vocabulary(spark):
    df = _frame(spark).repartition(3)
    tokens = df.select(F.explode(F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), F.lit(0))).alias("token"))
    counts = layout_token_counts(df, "text")
    assert sorted(counts.groupBy("token").agg(F.sum("n")).collect()) == sorted(tokens.groupBy("token").count().collect())
    assert build_vocab(counts, 12, times="n").collect() == build_vocab(tokens, 12).collect()


def test_counts_move_no_row_per_token(spark):
    plan = layout_token_counts(_frame(spark), "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "regexp" not in plan


def test_blocks_are_bounded_by_rows_and_bytes():
    texts = pa.array(["a" * n for n in (1, 2, 3, 50, 1, 1, 1, 1)])
    assert list(byte_blocks(texts, 3, 6)) == [(0, 3), (3, 1), (4, 3), (7, 1)]
    assert list(byte_blocks(texts.slice(0, 0), 3, 6)) == []


@pytest.mark.parametrize("fits", [True, False])
def test_columns_carried_along(spark, stub_vocab, monkeypatch, fits):
    monkeypatch.setattr(seq, "vocab_fits", lambda rows: fits)
    df = spark.createDataFrame([(1, "x = 1", "en"), (None, "a", None), (3, None, "de")], "doc_id long, text string, lang string")
    w = seq.wrapped_features(df, stub_vocab, "doc_id", "text", 8, carry=("text", "lang"))
    assert w.columns == ["doc_id", *seq.FEATURE_COLS, "text", "lang"]
    assert {(r.doc_id, r.text, r.lang, tuple(r.input_ids)) for r in w.collect()} == {
        (1, "x = 1", "en", (0, 5, 6, 7, 2)), (None, "a", None, (0, 8, 2)), (3, None, "de", (0, 3, 2))}


def test_source_columns_are_not_joined_again(spark):
    from arborform.plans import catalog as C
    plan = C.source_frame(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(doc_id") == 1


def test_integer_text(spark):
    rows = [([1, -2, 30],), ([],), ([None, 5, None],), (None,), ([None],), ([7],)]
    df = spark.createDataFrame(rows, "a array<int>")
    for sep, want in ((",", ["1,-2,30", "", "5", None, "", "7"]), ("/", ["1/-2/30", "", "5", None, "", "7"])):
        assert [r[0] for r in df.select(int_text(F.col("a"), sep)).collect()] == want


def test_masking_draws_in_one_pass(spark):
    """Digests stay in the pass that compares them, and seed and key are text once per row."""
    from arborform.operators import masking
    df = spark.createDataFrame([(7, [0, None, 9, 8, 7])], "doc_id long, input_ids array<int>")
    plan = masking.mask_tokens(df, "doc_id", 0.5, 123)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and "isnotnull(lambda" not in plan
