import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborform.llm.alignment import Aligner, alignments, groups_of

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "a", "the", "é", "'s", "1", "12", "!!", ".", "\0", "<|endoftext|>", "<s>", "</s>", "<0x41>", "▁", " ",
         "日本", "𝒳", "​", "ing", "runner", " runner", "ﬁ", "\r\n", "ñmiar,$$$"]


@pytest.fixture(scope="module")
def libs():
    import json

    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    # the byte of each character of a byte-level vocabulary, asked of the library itself
    from tokenizers.pre_tokenizers import ByteLevel
    byte = {}
    for c in map(chr, range(0x110000)):
        if not 0xD800 <= ord(c) < 0xE000 and (ord(c) < 0x800 or ord(c) % 997 == 0):
            for s, b in zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0], c.encode()):
                byte[s] = b
    for b in range(0xC0, 0x100):                # lead bytes that no character above has
        byte.setdefault(chr(b), b)
    vocab = {i: t for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    return a, sp, byte, vocab


def brute(texts, libs):
    """Rows by plain loops: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    a, sp, byte, vocab = libs
    docs, count = [], Counter()
    for t in texts:
        docs.append(None)
        if not t:
            continue
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
        ba = [bytes(byte[c] for c in vocab[i]) for i in ia]
        bb = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            continue

        def spans(parts):
            out, at = [], 0
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            return out
        sa, sb = spans(ba), spans(bb)
        links, j = [], 0
        for i, (s, e) in enumerate(sa):
            while sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                links.append((ia[i], ib[k]))
                k += 1
        shared = {e for _, e in sa} & {e for _, e in sb}
        groups, ga, gb = [], iter(zip(sa, ia)), iter(zip(sb, ib))
        for cut in sorted(shared):
            parts = []
            for it in (ga, gb):
                own = []
                while not own or end < cut:
                    (_, end), i = next(it)
                    own.append(str(i))
                parts.append(",".join(own))
            groups.append("|".join(parts))
        count.update(links)
        docs[-1] = (len(ia), len(ib), len(groups), links, ";".join(groups))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else
            (d[0], d[1], d[2], len(d[3]), sum(count[x] == top[x[1]] for x in d[3]), sum(count[x] for x in d[3]), d[4]) for d in docs]


def sample(seed, n):
    rnd = random.Random(seed)
    out = ["".join(rnd.choices(PARTS, k=rnd.randint(0, 14))) for _ in range(n)]
    return out + ["".join(rnd.choices("abelnrst ", k=rnd.randint(0, 40))) for _ in range(n)]


def test_tokens_equal_whole_calls(libs):
    a, sp, *_ = libs
    al = Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    assert al.b.cut
    texts = sample(1, 1500)
    ids, n = al.b.encode(texts)
    at = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == sp.encode(t), repr(t)


def test_divide_and_conquer_finds_every_shared_cut():
    rnd = random.Random(3)
    for case in range(200):
        n = rnd.choice([1, 2, 30, 400])
        share = rnd.choice([0, 0.02, 0.5, 1])
        cuts = sorted(rnd.sample(range(1, 4 * n), min(n, 4 * n - 1)))
        both = {c for c in cuts if rnd.random() < share}
        ends_a = np.array(sorted(both | {c for c in cuts if rnd.random() < 0.5}) + [4 * n])
        ends_b = np.array(sorted(both | {c for c in cuts if rnd.random() < 0.5}) + [4 * n])
        one = lambda x: np.array([x])
        a0, a1, b0, b1 = groups_of(ends_a, ends_b, one(0), one(len(ends_a)), one(0), one(len(ends_b)))
        want = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        assert ends_a[a1 - 1].tolist() == want and ends_b[b1 - 1].tolist() == want
        assert a0.tolist() == [0, *a1[:-1]] and b0.tolist() == [0, *b1[:-1]]


@pytest.mark.parametrize("most", [1 << 21, 20, 0])
def test_equals_brute_force(spark, libs, most):
    """All pairs sent to the tasks, some, or none."""
    texts = [*sample(2, 120), None, "", "same text", "same text", "word " * 3000, "a" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string").withColumn("pairs", F.lit(1)).withColumn("row", F.lit("c"))
    out = alignments(df.repartition(3), "key", "text", A, B, digest=False, most=most)
    got = {r["key"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, libs)


def test_odd_rows(spark, libs):
    rows = [(None, "no key"), (1, "twice"), (1, "twice"), (2, "x▁y")]
    out = alignments(spark.createDataFrame(rows, "doc bigint, t string"), "doc", "t", A, B)
    assert out.columns[0] == "doc" and out.count() == 4
    assert {r["groups"] for r in out.filter("doc = 2").collect()} == {""}
    assert alignments(spark.createDataFrame([], "doc bigint, t string"), "doc", "t", A, B).count() == 0


def test_query(spark, sf, libs):
    from arborform.llm.q_alignment import op13_alignment
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {d["doc_id"]: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for d, w in zip(docs, brute([d["text"] for d in docs], libs))}
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in op13_alignment(spark, sf).collect()}
    assert got == want
