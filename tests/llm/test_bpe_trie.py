import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborform.llm.bpe_trie import Decoder, Encoder, decode, encode, walk

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = {n: public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}
PARTS = [" ", "  ", "\n", "\t", "a", "aa", "the", "é", "é", "'s", "'S", "'", "1", "12", "!!", ".", "\0", " ", " ", "\x1c", "ß", "Σ",
         "AΣ", "İ", "<|endoftext|>", "<|startoftext|>", "日本", "𝒳", "̸", "=", "​", "ing", "er", "l", "ﬁ"]


@pytest.fixture(scope="module", params=sorted(PATHS))
def tools(request):
    from tokenizers import Tokenizer
    source = open(PATHS[request.param], encoding="utf-8").read()
    return Tokenizer.from_str(source), Encoder(source), Decoder(source)


def test_ids_and_text_equal_the_library(tools):
    lib, e, d = tools
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(PARTS, k=rnd.randint(0, 14))) for _ in range(2000)]
    texts += ["".join(rnd.choices("abelnrst", k=rnd.randint(0, 30))) for _ in range(1000)]
    texts += ["".join(rnd.choices("an", k=rnd.randint(0, 40))) for _ in range(300)]
    texts += [" ".join(rnd.choices(["running", "runner", "run", "rung", "<|endoftext|>x", "x<|endoftext|>"], k=50)), "", "a" * 5000]
    for t, g, x in zip(texts, e.encode(texts), lib.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(g, "<u4").tolist() == x.ids, t
        assert d.decode(g) == lib.decode(x.ids, skip_special_tokens=False)


def test_walk_equals_merging_by_rank(tools):
    """Against the textbook loop: merge the pair of the lowest rank, leftmost first."""
    _, e, _ = tools
    m, rnd = e.merges, random.Random(2)
    words = {"".join(rnd.choices("aeinrstl", k=rnd.randint(1, 12))) for _ in range(2000)}
    got = walk(list(words), m)
    for w in words:
        parts = [*w[:-1], w[-1] + m.suffix]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: m.rank.get((parts[i], parts[i + 1]), len(m.rank)))
            if (parts[best], parts[best + 1]) not in m.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        assert np.frombuffer(got[w], "<u4").tolist() == [m.ids[p] for p in parts], w


def test_a_small_memory_gives_the_same(monkeypatch):
    import arborform.llm.bpe_trie as b
    source = open(PATHS["word_bpe_49k.json"], encoding="utf-8").read()
    texts = [f"word{i} words{i % 7} other text {i * i}" for i in range(300)]
    whole = Encoder(source).encode(texts)
    monkeypatch.setattr(b, "HELD", 40)
    monkeypatch.setattr(b, "PAIRS", 10)
    e = Encoder(source)
    assert [x for i in range(0, 300, 7) for x in e.encode(texts[i:i + 7])] == whole


def test_odd_rows(spark):
    """Null and empty texts, null and repeated keys, a very long text, clashing columns."""
    from tokenizers import Tokenizer
    path = PATHS["word_bpe_49k.json"]
    lib = Tokenizer.from_file(path)
    long = "Long TEXT of words\n" * 40_000
    rows = [(1, "some text"), (2, None), (3, ""), (4, long), (5, "same"), (5, "same"), (None, "no key")]
    df = spark.createDataFrame(rows, "key bigint, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("c"))
    out = decode(encode(df, "key", "text", path), "key", "ids", path, keep=("n_tokens",))
    assert out.columns == ["key", "n_tokens", "ids", "decoded"]
    got = sorted((r["key"] is None, r["key"] or 0, r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in out.collect())
    ids = [(k, lib.encode(t or "", add_special_tokens=False).ids) for k, t in rows]
    assert got == sorted((k is None, k or 0, len(i), np.array(i, "<u4").tobytes(), lib.decode(i, skip_special_tokens=False)) for k, i in ids)
    assert encode(df.limit(0), "key", "text", path).count() == 0


def test_query(spark, sf):
    from tokenizers import Tokenizer

    from arborform.llm.q_bpe_trie import op12_bpe_trie
    lib = Tokenizer.from_file(PATHS["word_bpe_49k.json"])
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(tuple(r) for r in op12_bpe_trie(spark, sf).collect()) == sorted(want)
