import numpy as np
from pyspark.sql import functions as F

from arborform.llm.queries import queries
from arborform.llm.toxicity import FIXED_CURVE, automaton, features, fit, fit_curve, fold, fold_table, fold_word, measure, measured, without_toxic

MODEL = {"entries": {"idiot ": 4.0, "moro": 3.0}, "exceptions": ["idiot proof"], "curve": FIXED_CURVE}
MODEL["entries"] = {fold_word(k.strip()) + (" " if k.endswith(" ") else ""): v for k, v in MODEL["entries"].items()}
MODEL["exceptions"] = [fold_word(x) for x in MODEL["exceptions"]]


def count(texts):
    return measure(texts, MODEL, fold_table(), automaton(MODEL))


def test_folding_of_lookalikes_digits_and_accents():
    t = fold_table()
    want = fold("idiot", t)
    for w in ("IDIOT", "1d10t", "іdіot", "ïdîöt", "!diot", "ｉｄｉｏｔ"):
        assert fold(w, t) == want, w


def test_disguises_all_over_unicode():
    want = fold("idiot", fold_table())
    for w in ("𝓲𝓭𝓲𝓸𝓽", "id\u200biot", "i\u0308diot", "i\ufe0fdiot", "ⓘⓓⓘⓞⓣ", "idi\u00adot", "\U000e0069idiot"):
        assert fold(w, fold_table()) == want, w
    texts = ["𝓲𝓭𝓲𝓸𝓽", "id\u200biot", "i\u0308diot", "idiot😀", "idiot。", "😀idiot", "「idiot」", "ﬁne idiot"]
    assert count(texts)[1].tolist() == [1] * len(texts)
    assert fold("ﬁne", fold_table()) == fold("fine", fold_table())


def plain(text):
    """Weights by a plain scan: at each word the largest fitting entry, none inside an exception phrase."""
    words, at, pos = [], [], 1
    signs = "".join(fold_word(c) for c in text)
    for w in signs.split(" "):
        if w:
            words.append(w)
            at.append(pos)
        pos += len(w) + 1
    line = " " + signs + " "
    covered = set()
    for x in MODEL["exceptions"]:
        k = line.find(" " + x + " ")
        while k >= 0:
            covered.update(range(k + 1, k + 1 + len(x)))
            k = line.find(" " + x + " ", k + 1)
    hit = []
    for w, p in zip(words, at):
        fits = [v for e, v in MODEL["entries"].items() if (w + " ").startswith(e)]
        if fits and p not in covered:
            hit.append(max(fits))
    return sum(hit), len(hit), len(words)


def test_measure_equals_a_plain_scan():
    import random
    rnd = random.Random(4)
    parts = ["idiot", "IDIOT", "1d10t", "idiots", "moron", "moroccan", "idiot proof", "proof", " ", "\n", ".", "-", "é", "\u0301", "\u200b", "😀", "𝓲𝓭𝓲𝓸𝓽", "x"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(1500)] + [" ".join(rnd.choices(parts, k=9)) for _ in range(500)]
    total, hits, words = count(texts)
    for i, t in enumerate(texts):
        assert (total[i], hits[i], words[i]) == plain(t), repr(t)


def test_many_exception_phrases_take_linear_time():
    import time
    t = time.perf_counter()
    assert count(["idiot proof idiot " * 100_000])[1].tolist() == [100_000]
    assert time.perf_counter() - t < 60


def test_hits_words_beginnings_and_exceptions():
    texts = ["an idiot here", "idiots are other words", "idiot-proof box", "MORONIC", "oxymoron", "", "1d10t 1d10t.", "idiot\nidiot"]
    total, hits, words = count(texts)
    assert hits.tolist() == [1, 0, 0, 1, 0, 0, 2, 2]
    assert total.tolist() == [4, 0, 0, 3, 0, 0, 8, 8]
    assert words.tolist() == [3, 4, 3, 1, 1, 0, 2, 2]


def test_curve_of_separable_and_noisy_classes():
    rnd = np.random.default_rng(3)
    for n, noise in ((10_000, 0.0), (10_000, 0.02), (200, 0.0)):
        y = (rnd.random(n) < 0.1).astype(float)
        total = np.where(y > 0, rnd.uniform(10, 400, n), 0.0)
        total = np.where(rnd.random(n) < noise, rnd.uniform(1, 8, n), total)
        words = np.where(y > 0, total / 0.16, rnd.uniform(5, 3000, n))
        x = features(total, words)
        p = 1 / (1 + np.exp(-(x @ np.array(fit_curve(x, y)))))
        assert ((p >= 0.5) == (y > 0)).mean() > 0.99


def test_block_edges_do_not_matter():
    from arborform.llm import texts as T
    texts = [("word " * n) + ("idiot" if n % 3 == 0 else "") for n in range(60)]
    one = [x.tolist() for x in count(texts)]
    old, T.blocks.__defaults__ = T.blocks.__defaults__, (40,)
    try:
        assert [x.tolist() for x in count(texts)] == one
    finally:
        T.blocks.__defaults__ = old


def test_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "idiot " * 30_000, 1), (4, "fine words", 0), (4, "fine words", 0), (None, "idiot you idiot", 1)]
    df = spark.createDataFrame(rows, "k bigint, t string, y int").withColumn("total", F.lit(5)).withColumn("_text", F.lit("a"))
    m = fit(df, df.select("k", "y").filter("k is not null"), "k", "t", "y")
    out = {(r["k"], r["total"] > 0): r["score"] for r in measured(df.select("k", "t"), "t", m, keep=("k",)).collect()}
    assert out[3, True] > 0.5 > out[2, False] == out[1, False] and out[None, True] > 0.5
    kept = without_toxic(df, "t", m)
    assert kept.columns == df.columns and sorted(r["k"] for r in kept.collect()) == [1, 2, 4, 4]
    assert without_toxic(df.filter("k > 9"), "t", m).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    lab = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    r = (queries()["op4_toxicity"](spark, sf).join(lab, "doc_id").filter("held_out")
         .agg(F.avg((F.col("toxic") == F.col("predicted")).cast("double")).alias("a"),
              F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.count("*").alias("n")).first())
    assert r["n"] > 500 and r["a"] >= 0.98 and r["recall"] >= 0.85


def test_texts_are_measured_in_small_blocks(monkeypatch):
    from arborform.llm import toxicity
    sizes, plain = [], toxicity.folded
    monkeypatch.setattr(toxicity, "folded", lambda texts, table: sizes.append(sum(map(len, texts))) or plain(texts, table))
    model = {"entries": {"idiot ": 4.0}, "exceptions": [], "curve": toxicity.FIXED_CURVE}
    texts = ["an idiot " + "word " * 20_000] * 30
    total, hits, words = toxicity.measure(texts, model, toxicity.fold_table(), toxicity.automaton(model))
    assert max(sizes) < 700_000 and list(hits) == [1] * 30 and list(total) == [4.0] * 30 and list(words) == [20_002] * 30
