"""A1 as a data source of its own: compressed JSON lines in split folders.

Corpora are handed out as ``<path>/split=<name>/*.json.gz``, one JSON object a
line. ``spark.read.format("split_json").schema(...).load(path)`` reads them:

* every file is a partition (a gzip stream has no inner start), read line by line
  in blocks of ARROW_ROWS rows, so a task never holds a file;
* a filter on ``split`` drops whole folders at planning time;
* filters of equality on other columns, and of their negation, are applied to the
  lines before rows are built, so what Spark receives is already filtered;
* all other filters stay with Spark.

The path must be one that driver and executors see as a folder (a shared mount).
A missing field is null; a broken line fails the job, with its file and number,
or is passed over with the option ``broken = skip``.
"""

from __future__ import annotations

import glob
import gzip
import json
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, Not
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.batches import ship_package_by_value

FORMAT = "split_json"
ARROW_ROWS = 2_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def folder(path: str) -> str:
    """The folder of a plain path or a ``file:`` address."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{FORMAT} reads folders that driver and executors see, not {parts.scheme}:")
    return unquote(parts.path) if parts.scheme else path


def matches(kind: str, wanted, value) -> bool | None:
    """SQL's three-valued comparison of a pushed filter."""
    if kind == "is not null":
        return value is not None
    if kind == "<=>":
        return value == wanted if value is not None and wanted is not None else value is None and wanted is None
    if value is None or wanted is None:
        return None
    return value in wanted if kind == "in" else value == wanted


class File(InputPartition):
    def __init__(self, path: str, split: str):
        self.path, self.split = path, split


class SplitReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.schema = folder(options["path"]), schema
        self.skip = options.get("broken", "fail") == "skip"
        self.pushed = []                        # (column, kind, value, negated)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            inner, negated = (f.child, True) if isinstance(f, Not) else (f, False)
            kind = {EqualTo: "=", EqualNullSafe: "<=>", In: "in", IsNotNull: "is not null"}.get(type(inner))
            if kind is None or len(inner.attribute) != 1:
                yield f
            else:
                self.pushed.append((inner.attribute[0], kind, getattr(inner, "value", None), negated))

    def keeps(self, column: str, row: dict) -> bool:
        """Whether the pushed filters on a column keep the row (null drops it, as in SQL)."""
        for c, kind, wanted, negated in self.pushed:
            if c == column:
                hit = matches(kind, wanted, row.get(c))
                if hit is None or hit == negated:
                    return False
        return True

    def partitions(self) -> list[File]:
        found = []
        for d in sorted(glob.glob(os.path.join(glob.escape(self.path), "split=*"))):
            split = unquote(os.path.basename(d)[len("split="):])
            if self.keeps("split", {"split": split}):
                found += [File(p, split) for p in sorted(glob.glob(os.path.join(glob.escape(d), "*.json*"))) if os.path.getsize(p)]
        return found or [File("", "")]

    def read(self, part: File) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        schema, rows = to_arrow_schema(self.schema), []
        columns = {c for c, *_ in self.pushed} - {"split"}
        block = lambda: pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)
        with (gzip.open if part.path.endswith(".gz") else open)(part.path, "rt", encoding="utf-8") as f:
            for number, line in enumerate(f, 1):
                if not line.strip():
                    continue
                try:
                    row = json.loads(line)
                except ValueError:
                    if self.skip:
                        continue
                    raise ValueError(f"no JSON in line {number} of {part.path}") from None
                row["split"] = part.split
                if all(self.keeps(c, row) for c in columns):
                    rows.append(row)
                if len(rows) == ARROW_ROWS:
                    yield block()
                    rows = []
        if rows:
            yield block()


class SplitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise ValueError(f"{FORMAT} needs a schema")

    def reader(self, schema: StructType) -> SplitReader:
        return SplitReader(schema, self.options)


def read_json_splits(spark: SparkSession, path: str, schema: str, split: str | None = None, broken: str = "fail") -> DataFrame:
    """A1 over ``<path>/split=<name>/*.json.gz``: all splits, or one (the others' files are not opened).
    ``schema`` names the columns wanted, ``split`` among them or not."""
    ship_package_by_value()
    spark.dataSource.register(SplitSource)
    spark.conf.set(PUSHDOWN, "true")
    if "split" not in {f.name for f in StructType.fromDDL(schema)}:
        schema += ", split string"
    df = spark.read.format(FORMAT).schema(schema).option("broken", broken).load(path)
    return df if split is None else df.filter(F.col("split") == F.lit(split))


def write_json_splits(df: DataFrame, path: str) -> str:
    """``df`` with a ``split`` column as gzipped JSON lines in split folders."""
    df.write.partitionBy("split").option("compression", "gzip").json(path)
    return path
