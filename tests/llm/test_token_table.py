import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from arborform.llm.token_table import Encoder, read_tokens, with_starts, write_tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def test_special_strings_as_the_library_takes_them(tok):
    source = open(PATH, encoding="utf-8").read()
    assert Encoder(source, 2).encode(["a<|endoftext|>b"])[0].tolist() == tok.encode("a<|endoftext|>b", add_special_tokens=False).ids + [2]
    assert 50256 not in Encoder(source, 2, special=False).encode(["a<|endoftext|>b"])[0].tolist()


def test_pieces_equal_whole_texts(tok):
    e, rnd = Encoder(open(PATH, encoding="utf-8").read(), 2), random.Random(4)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "the", "é", "'s", "'", "1", "!!", ".", ",", "\0", "\u00a0", "\u2003", "\x1c", "B", "<|endoftext|>", "日本", "𝒳"]
    for _ in range(200):
        texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(30)]
        ids, at = e.encode(texts)
        for i, x in enumerate(tok.encode_batch(texts, add_special_tokens=False)):
            assert ids[at[i]:at[i + 1]].tolist() == x.ids + [2], texts[i]


def test_round_trip_and_edge_cases(spark, tmp_path, tok):
    rows = [(5, "some text"), (1, None), (3, ""), (2, "word " * 50_000), (5, "other"), (5, "other"), (None, "no key"), (4, "ü\n\nx")]
    df = spark.createDataFrame(rows, "k bigint, t string").withColumn("ids", F.lit(1)).withColumn("key", F.lit("c"))
    path = write_tokens(df, "k", "t", PATH, str(tmp_path / "t"), partitions=3)
    got = sorted((r["start"], r["k"], r["n_tokens"], r["ids_crc32"]) for r in with_starts(spark, path, "k").fillna(-1).collect())
    assert [k for _, k, *_ in got] == [-1, 1, 2, 3, 4, 5, 5, 5]
    at = 0
    left = {k: [] for k in range(-1, 6)}
    for k, t in rows:
        left[-1 if k is None else k].append(tok.encode(t or "", add_special_tokens=False).ids + [2])
    for start, k, n, crc in got:
        assert start == at
        at += n
        match = [x for x in left[k] if len(x) == n and zlib.crc32(np.array(x, "<u4").tobytes()) == crc]
        assert match
        left[k].remove(match[0])


def test_empty_table(spark, tmp_path):
    path = write_tokens(spark.createDataFrame([], "k bigint, t string"), "k", "t", PATH, str(tmp_path / "e"))
    assert with_starts(spark, path, "k").count() == 0


def test_selective_reads_and_encodings(spark, tmp_path):
    df = spark.range(4000).select(F.col("id").alias("k"), F.concat_ws(" ", F.lit("text"), F.col("id"), F.sha2(F.col("id").cast("string"), 256)).alias("t"))
    path = write_tokens(df, "k", "t", PATH, str(tmp_path / "s"), partitions=2, row_group=64 << 10, page=4 << 10)
    assert [r["k"] for r in read_tokens(spark, path, "k", keys=[7, 3999]).orderBy("k").collect()] == [7, 3999]
    plan = read_tokens(spark, path, "k", keys=[7], columns=["k", "n_tokens"])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(k" in plan or "EqualTo(k,7)" in plan
    assert "ids" not in plan.split("ReadSchema:")[1].split("\n")[0]
    meta = pq.read_metadata(next((tmp_path / "s").glob("part-*.parquet")))
    assert meta.num_row_groups > 1
    group = meta.row_group(0)
    by = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert any("DELTA_BINARY_PACKED" in x for x in by["k"].encodings)
    assert any("DICTIONARY" in x for x in by["ids.list.element"].encodings)
    assert by["k"].has_offset_index and by["k"].has_column_index
