import numpy as np
from pyspark.sql import functions as F

from arborform.llm import language
from arborform.llm.language import KneserNey, Model, Symbols, fit, grams, predict
from arborform.llm.queries import queries

EN = "the cat and the dog are in the house with this thing that they have"
DE = "der hund und die katze sind in dem haus mit einem ding das sie haben"


def counts(texts):
    k, c = np.unique(grams(*Symbols().of(texts))[0], return_counts=True)
    return k, c


def test_probabilities_sum_to_one():
    k, c = counts([EN, EN + " again and again"])
    letters = len(np.unique(k & np.uint64(0xFFFF)))
    lm = KneserNey(k, c, letters)
    context = k[len(k) // 2] >> np.uint64(16)
    every = (context << np.uint64(16)) | np.unique(k & np.uint64(0xFFFF))
    assert abs(lm.prob(every).sum() - 1) < 1e-9
    unseen = (np.uint64(0x0041004200430000)) | np.unique(k & np.uint64(0xFFFF))
    assert abs(lm.prob(unseen).sum() - 1) < 1e-9


def test_hashed_lookup_equals_direct():
    sets = [counts([EN]), counts([DE])]
    m = Model(["de", "en"], [sets[1][0], sets[0][0]], [sets[1][1], sets[0][1]])
    every = np.unique(np.concatenate([s[0] for s in sets]))
    at = m.find(every)
    assert (at >= 0).all()
    for j, p in enumerate(m.parts):
        assert np.allclose(m.costs[j][at], -np.log2(p.prob(every)), atol=1e-4)
    assert m.find(np.array([np.uint64(1)]))[0] == -1


def test_edge_cases(spark):
    rows = [(1, EN, "en"), (2, DE, "de"), (3, None, "en"), (4, "", "de"), (5, "123 %% \n", "en"), (6, EN, None),
            (6, EN, None), (7, EN * 2000, "en"), (8, "𝒳", "en"), (9, "hund", None)]
    df = spark.createDataFrame(rows, "k bigint, t string, lang string").withColumn("score", F.lit(1)).withColumn("_text", F.lit("x"))
    m = fit(df.filter("k in (1, 2, 7)"), "k", "lang", "t")
    out = [(r["k"], r["lang_pred"], r["score"]) for r in predict(df.select("k", "t"), "t", m, keep=("k",)).collect()]
    got = {k: p for k, p, _ in out}
    assert len(out) == len(rows)
    assert [got[k] for k in (1, 2, 3, 4, 5, 6, 7, 9)] == ["en", "de", "und", "und", "und", "en", "en", "de"]
    assert got[8] in ("en", "de")
    assert all(0 <= s <= 1 for *_, s in out) and all(s == 0 for _, p, s in out if p == "und")


def test_nothing_learnt_and_empty(spark):
    df = spark.createDataFrame([(1, EN, None)], "k bigint, t string, lang string")
    m = fit(df, "k", "lang", "t")
    assert m is None
    assert [r["lang_pred"] for r in predict(df.select("k", "t"), "t", m, keep=("k",)).collect()] == ["und"]
    assert predict(df.filter("k > 5").select("k", "t"), "t", m, keep=("k",)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = queries()["op2_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert r["n"] > 100 and r["a"] >= 0.98


def test_every_ngram_is_in_the_model_whatever_its_parts(spark, monkeypatch):
    texts = {"de": [DE, DE + " nur einmal hier"], "en": [EN + f" word{i} again" for i in range(30)], "xx": ["zyx wvu"]}
    want = Model(sorted(texts), *zip(*[counts(texts[x]) for x in sorted(texts)]))
    df = spark.createDataFrame([(i, t, x) for x in texts for i, t in enumerate(texts[x])], "k bigint, t string, lang string")
    probe = [EN, DE, "zyx wvu", "zyx of the hund", "something new quite unseen", "Ω ж"]
    # small parts, kept and read again for each block of texts
    for size, held in ((7, 10 ** 9), (7, 0), (10 ** 9, 10 ** 9)):
        monkeypatch.setattr(language, "PART_GRAMS", size)
        monkeypatch.setattr(language, "HELD_BYTES", held)
        m = fit(df, "k", "lang", "t")
        assert m.langs == ["de", "en", "xx"] and (len(m.source) > 20) == (size == 7)
        for a, b in zip(m.entropies(probe, Symbols()), want.entropies(probe, Symbols())):
            assert np.allclose(a, b, atol=1e-4)
    got = [r["lang_pred"] for r in predict(df.filter("lang = 'xx'").select("k", "t"), "t", m, keep=("k",)).collect()]
    assert got == ["xx"]


def test_temperature_and_limits_come_from_every_training_row(spark):
    texts = {"de": [DE + f" {w} nummer" for w in ("eins", "zwei", "drei", "vier", "xylophon") * 8], "en": [EN + " " + w * 9 for w in ("one", "two", "qqq") * 12]}
    rows = [(i, t, x) for x in texts for i, t in enumerate(texts[x])] * 60      # 4,560 rows, keys repeat
    df = spark.createDataFrame(rows, "k bigint, t string, lang string").repartition(5)
    m = fit(df, "k", "lang", "t")
    ce, size, letter = m.entropies([t for _, t, _ in rows], Symbols())
    truth = np.array([m.langs.index(x) for *_, x in rows])
    for j in (0, 1):
        own = ce[truth == j, j]
        assert abs(m.limits[j] - (own.mean() + language.REJECT_SD * own.std())) < 1e-6
    z = [-b * np.sqrt(size)[:, None] * ce for b in language.BETAS]
    loss = [np.logaddexp.reduce(x, axis=1).sum() - x[np.arange(len(truth)), truth].sum() for x in z]
    assert abs(loss[list(language.BETAS).index(m.beta)] - min(loss)) < 1e-6
