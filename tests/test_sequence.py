import random

import pytest
from pyspark.sql import functions as F

from arborform.operators import sequence as seq
from arborform.operators.shape import exclude_lang, unsupported


def kept(leaves, ref):
    """The rule read off an iterator over the reference: a leaf is aligned if it
    is the awaited token; once none is awaited, every leaf is."""
    awaited, done = iter(ref), object()
    want, out = next(awaited, done), []
    for leaf in leaves:
        hit = want is done or leaf == want
        out.append(int(hit))
        if hit and want is not done:
            want = next(awaited, done)
    return out


def _align(spark, rows, chunk=512):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)],
                               "k int, l array<string>, r array<string>")
    out = df.select("k", seq.align_mask(F.col("l"), F.col("r"), chunk).alias("m")).orderBy("k")
    return [list(r.m) for r in out.collect()]


@pytest.mark.parametrize("leaves,ref,expected", [
    (["x", "=", "1"], ["x", "1"], [1, 0, 1]),          # dropped reference token
    (["a", "b", "c"], ["a"], [1, 1, 1]),                # reference exhausted
    (["a", "b", "c"], ["a", "z", "c"], [1, 0, 0]),      # reference stuck
    (["a", "b"], [], [1, 1]),                           # empty reference
    ([], ["a"], []),
])
def test_align_cases(spark, leaves, ref, expected):
    assert _align(spark, [(leaves, ref)]) == [expected]


def test_align_random_against_the_rule(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(60):
        leaves = [rnd.choice("abcde") for _ in range(rnd.randint(0, 1300))]
        ref = [x for x in leaves if rnd.random() < 0.8]
        if rnd.random() < 0.3:
            ref.insert(rnd.randint(0, len(ref)), "zz")
        rows.append((leaves, ref))
    want = [kept(a, b) for a, b in rows]
    assert _align(spark, rows, chunk=64) == want      # many chunks
    assert _align(spark, rows) == want


def _features(spark, vocab, texts, L=32, align=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in seq.features(df, vocab, length=L, align=align).collect()}


def test_features_wrap_and_pad(spark, stub_vocab):
    """Two lines: the second one's tokens start at sibling 0 again; '+' is no word."""
    r = _features(spark, stub_vocab, ["a + b\n1"], L=11)[0]
    assert list(r.input_ids) == [0, 8, 9, 10, 7, 2, 0, 0, 0, 0, 0]
    assert list(r.attention_mask) == [1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]
    assert list(r.depths) == [-1, 2, 2, 2, 2, -1, -1, -1, -1, -1, -1]
    assert list(r.sibling_indices) == [-1, 0, 1, 2, 0, -1, -1, -1, -1, -1, -1]
    assert list(r.tree_attention_mask) == [0, 1, 0, 1, 1, 0, 0, 0, 0, 0, 0]


def test_features_truncate_long_input(spark, stub_vocab):
    text = " + ".join(f"v{i}" for i in range(42))
    r = _features(spark, stub_vocab, [text])[0]
    assert all(len(r[c]) == 32 for c in seq.FEATURE_COLS)
    assert r.input_ids[-1] == 2 and r.attention_mask[-1] == 1
    assert r.input_ids[1] == 3  # unknown token


def test_features_exactly_fills_and_unknown_mask(spark, stub_vocab):
    r = _features(spark, stub_vocab, ["x q 1"], L=5, align=False)[0]
    assert r.input_ids == [0, 5, 3, 7, 2]
    m = spark.createDataFrame([(r.input_ids, r.tree_attention_mask)], "i array<int>, m array<int>")
    assert m.select(seq.mask_unknown(F.col("i"), F.col("m"))).first()[0] == [0, 1, 0, 1, 0]


def test_position_ids(spark):
    df = spark.createDataFrame([([5, 6, 7, 1, 1],), ([0, 9, 2, 0, 0],)], "ids array<int>")
    got = [r[0] for r in df.select(seq.position_ids(F.col("ids"))).collect()]
    assert got == [[2, 3, 4, 1, 1], [2, 3, 4, 5, 6]]


def test_check_lengths_and_ranges(spark):
    df = spark.createDataFrame([(1, [1, 2], [0, 1]), (2, [1], [0])],
                               "doc_id long, input_ids array<int>, depths array<int>")
    assert [r.doc_id for r in seq.check_lengths(df, 2, ["input_ids", "depths"]).collect()] == [2]
    with pytest.raises(Exception, match="length"):
        seq.check_lengths(df, 2, ["input_ids", "depths"], strict=True).collect()


def test_language_filters(spark):
    df = spark.createDataFrame([(1, "php"), (2, None), (3, "python"), (4, "cobol")],
                               "doc_id long, lang string")
    assert sorted(r.doc_id for r in exclude_lang(df, "php").collect()) == [2, 3, 4]
    assert sorted(r.doc_id for r in unsupported(df, ["python", "php"]).collect()) == [2, 4]
    with pytest.raises(Exception, match="supported list"):
        unsupported(df, ["python", "php"], strict=True).collect()


def test_vocab_takes_the_most_frequent(spark):
    from arborform.operators.vocab import build_vocab
    toks = spark.createDataFrame([(f"t{i % 97}",) for i in range(3000)] +
                                 [(f"u{i % 13}",) for i in range(500)] + [(" ",), ("<s>",)], "token string")
    plain = sorted(build_vocab(toks, 40).collect())
    assert len(plain) == 45
    ids = {r.token: r.id for r in plain}
    assert ids["<s>"] == 0 and " " not in ids and ids["u0"] == 5  # u* tokens are most frequent


def test_keep_features_and_model_columns_pair_forms(spark):
    from arborform.operators.shape import keep_features, model_columns
    cols = [f"{c}_{s}" for s in (1, 2) for c in seq.FEATURE_COLS]
    schema = "pair_id long, text string, " + ", ".join(f"{c} array<int>" for c in cols) + ", labels int"
    df = spark.createDataFrame([tuple([1, "t"] + [[1]] * 10 + [1])], schema)
    assert keep_features(df, "pair_id").columns == ["pair_id"] + cols + ["labels"]
    assert model_columns(df, "pair_id", tree=False, pair=True).columns == [
        "pair_id", "input_ids_1", "attention_mask_1", "input_ids_2", "attention_mask_2", "labels"]
    assert len(model_columns(df, "pair_id", tree=True, pair=True).columns) == 12


def test_features_null_text_and_repeated_key(spark, stub_vocab):
    df = spark.createDataFrame([(1, "x = 1"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.input_ids for r in seq.features(df, stub_vocab, length=8, vocab_rows=11).collect()}
    assert set(got) == {1, 2, 3} and got[2] == got[3]
    twice = spark.createDataFrame([(1, "x = 1"), (1, "a + b")], "doc_id long, text string")
    with pytest.raises(Exception, match="repeated key"):
        seq.features(twice, stub_vocab, length=8, vocab_rows=11).collect()


def test_features_from_leaves_equal_features(spark, stub_vocab):
    from arborform.operators.sequence import features_from_leaves
    from arborform.operators.trees import layout_leaves
    df = spark.createDataFrame([(1, "x = 1\n\na + b"), (2, "x " * 40), (3, "")], "doc_id long, text string")
    a = sorted(seq.features(df, stub_vocab, length=16, vocab_rows=11).collect())
    leaves = layout_leaves(df, "doc_id", "text")
    assert sorted(features_from_leaves(leaves, stub_vocab, "doc_id", 16, vocab_rows=11).collect()) == a


def test_markup_features_have_nested_depths(spark, stub_vocab):
    from arborform.operators.sequence import features_from_leaves
    from arborform.operators.trees import markup_leaves
    df = spark.createDataFrame([(1, "<div>x<ul><li>1</li><li>a</li></ul></div>b")], "k long, html string")
    r = features_from_leaves(markup_leaves(df, "k", "html"), stub_vocab, "k", 8, vocab_rows=11).first()
    assert r.input_ids == [0, 5, 7, 8, 10, 2, 0, 0]
    assert r.depths == [-1, 1, 3, 3, 0, -1, -1, -1]
    assert r.sibling_indices == [-1, 0, 0, 0, 1, -1, -1, -1]


def test_pair_features_null_sides(spark, stub_vocab):
    from arborform.operators.pairs import pair_features
    df = spark.createDataFrame([(1, None, "x = 1", 1), (2, "x = 1", None, 0), (3, None, None, 1)],
                               "pair_id long, text_1 string, text_2 string, similar int")
    got = {r.pair_id: r for r in pair_features(df, stub_vocab, 8, vocab_rows=11).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].input_ids_1 == got[2].input_ids_2 == got[3].input_ids_1
    assert got[1].input_ids_2 == got[2].input_ids_1 and got[1].labels == 1


def test_the_walk_copies_no_leaf(spark):
    """A cast of the leaves would make each of them anew."""
    from arborform.operators.trees import layout_leaf_array
    texts = ["x = 1\n\nz", "", None, "\n", " \t"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string").select("k", layout_leaf_array(F.col("text")).alias("a"))
    assert "cast(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: [tuple(x) for x in r.a] for r in df.collect()} == {
        0: [("x", 2, 0), ("=", 2, 1), ("1", 2, 2), ("", 1, 1), ("z", 2, 0)], 1: [("", 0, 0)], 2: [("", 0, 0)],
        3: [("", 1, 0), ("", 1, 1)], 4: [(" \t", 1, 0)]}


ODD_TEXTS = ["x = 1 + y\n\nz = x", "", None, "\n", " \t", "a\n \nb b _ é1", "1 + " * 40, "\n\na"]


def _wrapped(spark, vocab, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string")
    return seq.wrapped_features(df, vocab, "doc_id", "text", 32, **kw)


@pytest.mark.parametrize("align", [True, False])
def test_joined_by_block_or_by_leaf_is_the_same(spark, stub_vocab, monkeypatch, align):
    here = sorted(_wrapped(spark, stub_vocab, align=align).collect())
    monkeypatch.setattr(seq, "vocab_fits", lambda rows: False)
    assert sorted(_wrapped(spark, stub_vocab, align=align).collect()) == here
    assert len(here) == len(ODD_TEXTS)
    by = {r.doc_id: r for r in here}
    assert by[1].depths == [-1, 0, -1] and by[3].depths == [-1, 1, 1, -1] and by[3].sibling_indices == [-1, 0, 1, -1]


def test_features_move_no_row_per_leaf(spark, stub_vocab):
    plan = _wrapped(spark, stub_vocab, vocab_rows=11)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan
    assert "BroadcastHashJoin" in plan and plan.count("hashpartitioning") == 1


def test_features_repeated_key_or_token_fails(spark, stub_vocab):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string")
    with pytest.raises(Exception, match="repeated key: 1"):
        seq.features(df, stub_vocab, length=32).collect()
    twice = stub_vocab.unionByName(spark.createDataFrame([("a", 99)], "token string, id int"))
    with pytest.raises(Exception, match="repeated token"):
        seq.features(df.limit(1), twice, length=32).collect()
