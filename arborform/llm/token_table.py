"""Operator 6: token ids in Parquet list columns.

Texts are put in key order by a range shuffle, encoded inside the tasks and
written as one row per document: key, number of ids, ids. The files are written
by Spark's committer (a lost executor repeats its file), with dictionary
encoding for the ids, delta encoding for key and counts, row groups and pages of
a set size, and page indexes, so a read of a few keys touches their pages and a
read of the counts never touches the ids.

Encoding. Byte-level BPE splits a text before it merges, and never across a
single space or line break between other characters, nor from an ASCII letter
to a mark other than the apostrophe. The text is cut there; the
pieces of a block are made distinct, only pieces not met before go through the
tokenizer, and the ids are put together in arrays. Texts with other white space
than ASCII's, and tokenizers of other kinds, are encoded whole, and so are texts that hold the string
of an added token.

Defined results: a null text is the empty text (the end id alone); a null key
comes first; equal keys are ordered by the hash of the text; an empty table
gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .texts import blocks, column, ship_by_value, worker_state

END_ID = 2
ROW_GROUP = 32 << 20
PAGE = 128 << 10
CACHE_PIECES = 500_000      # pieces that a worker remembers
BLOCK = 4_000_000           # characters encoded at once
CALL = 500                  # new pieces in one text for the tokenizer
OTHER_SPACE = re.compile(rb"[\x00\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class Encoder:
    """Texts to ids, equal to the tokenizer's own on each whole text."""

    def __init__(self, source: str, end_id: int, special: bool = True):
        """``special``: strings of added tokens in a text become those tokens,
        as in the library's own call; else they are ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.t = Tokenizer.from_str(source)
        self.t.encode_special_tokens = not special
        conf = json.loads(source)
        self.added = [a["content"].encode() for a in conf.get("added_tokens") or []] if special else []
        pre = conf.get("pre_tokenizer") or {}
        self.pieces = (conf.get("normalizer") is None and pre.get("type") == "ByteLevel"
                       and pre.get("use_regex", True) and not pre.get("add_prefix_space"))
        self.end, self.cache = np.array([end_id], "<u4").tobytes(), {}
        self.line = self.t.encode("\n", add_special_tokens=False).ids
        # classes of bytes: 1 white, 2 letter, 4 mark (no apostrophe), 8 may begin what OTHER_SPACE finds
        self.kind = np.zeros(256, np.uint8)
        self.kind[[9, 10, 11, 12, 13, 32]] = 1
        self.kind[[*range(65, 91), *range(97, 123)]] = 2
        self.kind[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 4
        self.kind[[0, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = 8

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """Put the ids of pieces into the cache, many pieces to a call."""
        plain = [p for p in new if "\n" not in p]
        parts = [plain[i:i + CALL] for i in range(0, len(plain), CALL)]
        for part, e in zip(parts, self.t.encode_batch_fast(["\n".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cut = np.flatnonzero(ids == self.line[0])
            if len(self.line) == 1 and len(cut) == len(part) - 1:
                at = np.concatenate([[0], cut + 1]) * 4
                end = np.concatenate([cut, [len(ids)]]) * 4
                raw = ids.tobytes()
                self.cache.update((p, raw[a:b]) for p, a, b in zip(part, at.tolist(), end.tolist()))
            else:
                self.cache.update(zip(part, self.whole(part)))
        rest = [p for p in new if "\n" in p]
        if rest:
            self.cache.update(zip(rest, self.whole(rest)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and where each begins."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        kind = self.kind[np.frombuffer(b"".join(raw), np.uint8)]
        edge = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
        rare = np.unique(np.searchsorted(edge, np.flatnonzero(kind == 8), side="right") - 1).tolist()
        odd = set(range(len(raw))) if not self.pieces else {i for i in rare if OTHER_SPACE.search(raw[i])}
        odd |= {i for i, b in enumerate(raw) if any(a in b for a in self.added)}
        own = dict(zip(sorted(odd), self.whole([texts[i] for i in sorted(odd)])))
        # every text stands behind a zero byte, which is a piece of its own: its end id
        data = b"".join(b"\0" + (b"" if i in odd else b) for i, b in enumerate(raw)) + b"\0"
        buf = np.frombuffer(data, np.uint8)
        lens = np.array([1 if i in odd else len(b) + 1 for i, b in enumerate(raw)])
        begin = np.concatenate([[0], np.cumsum(lens)])
        kind = self.kind[buf]
        white = kind == 1
        single = np.zeros(len(buf), bool)
        single[1:-1] = white[1:-1] & ~white[:-2] & ~white[2:]
        space, line = single & (buf == 32), single & (buf == 10)
        # a space after a text's beginning, or before its end, cuts like any other
        cut = space | line
        cut[1:] |= line[:-1] | ((kind[1:] == 4) & (kind[:-1] == 2))
        cut[begin] = True
        cut[begin[:-1] + 1] = True
        at = np.flatnonzero(cut)[:-1]
        edges = np.append(at, len(buf) - 1).astype(np.int32)
        units = pa.StringArray.from_buffers(len(at), pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
        names = units.dictionary.to_pylist()
        marks = np.isin(at, begin)                      # the zero byte before each text
        new = [n for n in names if n not in self.cache and n != "\0"]
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache = {n: self.cache[n] for n in names if n in self.cache}
        self.learn(new)
        known = [b"" if n == "\0" else self.cache[n] for n in names]
        which = units.indices.to_numpy().astype(np.int64)
        # marks become the end of the text before; a last one ends the last text
        order = [self.end] + [own[i] for i in sorted(odd)]
        size0 = len(known)
        which[marks] = size0
        which = np.append(which, size0)
        first = np.flatnonzero(np.append(marks, True))
        for n, i in enumerate(sorted(odd)):
            which[first[i]] = size0                     # stays the end of the text before
        known += order
        if odd:
            places = first[sorted(odd)] + 1
            which = np.insert(which, places, size0 + 1 + np.arange(len(odd)))
            first = first + np.searchsorted(places, first, side="right")
        size = np.array([len(k) // 4 for k in known])
        flat = np.frombuffer(b"".join(known), "<u4")
        begin_of = np.concatenate([[0], np.cumsum(size)])[:-1]
        which = which[1:]                               # nothing ends before the first text
        n = size[which]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin_of[which] - before[:-1], n) + np.arange(before[-1])]
        return ids, before[first]


def write_tokens(df: DataFrame, key: str, text: str, tokenizer_path: str, path: str, end_id: int = END_ID,
                 partitions: int | None = None, row_group: int = ROW_GROUP, page: int = PAGE) -> str:
    """Encode ``text`` of all rows and write key, n_tokens, ids in key order."""
    ship_by_value()
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()                               # the driver's file, shipped to the tasks
    kind = df.select(F.col(key).alias("key")).schema[0].dataType.simpleString()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
            .withColumn("h", F.xxhash64("text")).repartitionByRange(n, "key", "h").sortWithinPartitions("key", "h")
            .select("key", "text"))

    def run(batches):
        e = worker_state(f"encoder {zlib.crc32(source.encode())} {end_id}", lambda: Encoder(source, end_id))
        for batch in batches:
            texts, keys = column(batch, "text"), batch.column(batch.schema.get_field_index("key"))
            for lo, hi in blocks(texts, BLOCK):
                ids, starts = e.encode(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), pa.array(np.diff(starts).astype(np.int32)), lists],
                                                 names=["key", "n_tokens", "ids"])
    out = rows.mapInArrow(run, f"key {kind}, n_tokens int, ids array<int>").withColumnRenamed("key", key)
    (out.write.option("compression", "zstd").option("parquet.block.size", row_group).option("parquet.page.size", page)
        .option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "true")
        .option(f"parquet.enable.dictionary#{key}", "false").option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path))
    return path


def read_tokens(spark: SparkSession, path: str, key: str, keys=None, columns=None) -> DataFrame:
    """The token table, or some keys (row groups and pages without them are
    skipped), or some columns (the others are not read)."""
    df = spark.read.parquet(path)
    if keys is not None:
        df = df.filter(F.col(key).isin(list(keys)))
    return df.select(*columns) if columns else df


def with_starts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """key, start, n_tokens, ids_crc32 read back from the files.

    File names follow the key ranges, and rows keep their place in a file:
    running sums inside each file are shifted by the totals of the files before.
    """
    ship_by_value()
    kind = spark.read.parquet(path).schema[key].dataType.simpleString()
    rows = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"),
                                           F.col(key).alias("key"), "ids")

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            at = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            crc = [zlib.crc32(raw[a * 4:b * 4]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2),
                                              pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                                             names=["file", "row", "key", "n_tokens", "ids_crc32"])
    sums = rows.mapInArrow(run, f"file string, row bigint, key {kind}, n_tokens bigint, ids_crc32 bigint")
    files = (spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), "n_tokens")
             .groupBy("file").agg(F.sum("n_tokens").alias("all")))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)      # one row per file
    files = files.select(F.col("file").alias("file2"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("first"))
    run_sum = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    inside = sums.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(run_sum), F.lit(0)))
    return inside.join(F.broadcast(files), F.col("file") == F.col("file2")).select(
        F.col("key").alias(key), (F.col("first") + F.col("ahead")).cast("bigint").alias("start"), "n_tokens", "ids_crc32")
