"""Text lines, binary records, manifests and local pairs."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.lookup import sized
from millrace.operators.partition import by_number
from millrace.storage import ship


def lines_of(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(key, value) per line of a text column: key counts from 0, value has its line feed; CR and CR LF end lines too."""
    whole = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n|\r", "\n")
    parts = F.split(whole, "\n", -1)
    # what follows the last line feed is a line only if it isn't empty
    ended = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.concat(x, F.lit("\n")))
    found = F.when(F.element_at(parts, -1) != "", F.concat(ended, F.slice(parts, -1, 1))).otherwise(ended)
    return df.select(*keep, F.posexplode(found).alias("key", "value")).withColumn("key", F.col("key").cast("bigint"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(key, value) per line, key from 0 in each file; large files are read by many tasks.

    A value has a line feed at its end; CR and CR LF end lines too and come as one. The last line of a file has none
    if the file has none; compressed files are taken to have one.
    """
    return _numbered(spark, paths).select("key", F.when(F.col("open"), F.col("value")).otherwise(F.concat("value", F.lit("\n"))).alias("value"))


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, key, value) per line without its end; large files are read by many tasks."""
    return _numbered(spark, paths).select("path", "key", "value")


def _numbered(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, key, value, open): lines without ends; whether a line is its file's last and has no end.

    A line's number is its place in its block plus the lines of the file's blocks before, which are counted first:
    a row per block is all that is gathered. A file's lines with a byte each for their ends are as long as the file,
    or a byte longer if the last one has no end (three less where the reader passes over a byte-order mark).
    """
    meta = {c: F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start", "file_size")}
    text = spark.read.option("lineSep", "\n").text(paths).select("value", meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"))
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\r", -1)
    cut = text.select("path", "block", "size", (F.octet_length("value") + 1).alias("bytes"), F.col("value").endswith("\r").alias("closed"), F.posexplode(parts).alias("i", "value"), F.size(parts).alias("of"))
    # a block's rows have consecutive ids in their task
    rows = cut.withColumn("m", F.monotonically_increasing_id())
    blocks = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"), F.max("size").alias("size"), F.sum(F.when(F.col("i") == 0, F.col("bytes"))).alias("bytes"))
    upto, whole = Window.partitionBy("path").orderBy("block"), Window.partitionBy("path")
    more = F.sum("bytes").over(whole) - F.col("size")
    starts = blocks.select(
        "path", "block", (F.sum("n").over(upto) - F.col("n") - F.col("first")).alias("shift"), (F.sum("n").over(whole) - 1).alias("last"),
        ((more == 1) | (more == -2)).alias("open_end"),
    )
    joined = rows.join(sized(starts), ["path", "block"])
    plain = ~F.lower("path").rlike("[.](gz|bz2|zst|lz4|snappy|deflate)$")
    key = F.col("m") + F.col("shift")
    return joined.select("path", key.alias("key"), "value", (F.col("open_end") & (key == F.col("last")) & ~F.col("closed") & plain).alias("open"))


def read_byte_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(key, value) per line as bytes, ended by LF alone."""

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                got = data.as_buffer().to_pybytes().split(b"\n")
                out = [x + b"\n" for x in got[:-1]] + ([got[-1]] if got[-1] else [])
                yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int64()), pa.array(out, pa.binary())], names=["key", "value"])

    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select("content")
    return files.mapInArrow(run, "key bigint, value binary")


def read_records(spark: SparkSession, paths: str | list[str], form: str, names: list[str]) -> DataFrame:
    """Fixed-width records in a form of Python's ``struct``, as ``>IHI``, one column per field. Blocks are read in parallel.

    Spark's record reader hands out bytes, which go to Arrow batches in the JVM; these are unpacked at once by numpy.
    """
    codes = [(n, c) for n, c in re.findall(r"(\d*)([a-zA-Z?])", form)]
    if form[:1] not in "<>" or any(n or c not in _NUMPY for n, c in codes) or len(codes) != len(names):
        raise ValueError("a form with < or >, and a code of a number for each name")
    kind = np.dtype([(n, form[0] + _NUMPY[c]) for n, (_, c) in zip(names, codes)])
    types = {n: "double" if c in "efd" else "decimal(20,0)" if c == "Q" else "bigint" for n, (_, c) in zip(names, codes)}
    schema = ", ".join(f"`{n}` {t}" for n, t in types.items())
    ship(spark)

    def run(batches):
        for batch in batches:
            got = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=kind)
            cols = [got[n].astype(got[n].dtype.newbyteorder("=")) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(map(Decimal, x.tolist()), pa.decimal128(20, 0)) if types[n].startswith("dec") else pa.array(x.astype(np.float64 if types[n] == "double" else np.int64)) for n, x in zip(names, cols)], names=names)

    where = ",".join([paths] if isinstance(paths, str) else paths)
    records = spark.sparkContext._jsc.binaryRecords(where, kind.itemsize).rdd()
    raw = spark._jsparkSession.createDataset(records, spark.sparkContext._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF()
    return DataFrame(raw, spark).mapInArrow(run, schema)


_NUMPY = {"b": "i1", "B": "u1", "h": "i2", "H": "u2", "i": "i4", "I": "u4", "l": "i4", "L": "u4", "q": "i8", "Q": "u8", "e": "f2", "f": "f4", "d": "f8"}


#: Steps of random walks: walk, hop, node.
WALK_FORM, WALK_NAMES = ">IHI", ["walk", "hop", "node"]


def read_table(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Lines of fields between tabs, with no quotes: names of nodes and of relations."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", "FAILFAST").csv(paths)


#: Types of the two kinds of such files.
RELATIONS, NODE_NAMES = "s bigint, t bigint, name string", "node bigint, name string"


def read_manifest(spark: SparkSession, path: str) -> list[str]:
    """Input paths, one to a line of a text file; empty lines are left out."""
    return [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()]


def local_data(spark: SparkSession, pairs: Iterable, schema: str = "key bigint, value bigint", splits: int | None = None, partition=None) -> DataFrame:
    """Pairs of the driver. ``splits``: dealt round robin in the given order, or by ``partition`` (df, n)."""
    if partition is not None and splits is None:
        raise ValueError("a partitioner needs a number of splits")
    pairs = list(pairs)
    if splits is None:
        return spark.createDataFrame(pairs, schema)
    if partition is not None:
        df = spark.createDataFrame(pairs, schema)
        return partition(df, splits) if splits > 1 else df.coalesce(1)
    placed = spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], f"{schema}, _place bigint")
    return by_number(placed, splits, F.col("_place") % splits).drop("_place")


@dataclass(frozen=True)
class Cell:
    source: int
    split: int
    url: str


def grid(urls: list[str], sources: int | None = None, splits: int | None = None, first_source: int = 0, first_split: int = 0) -> list[Cell]:
    """Places of files in a grid of sources and splits; one split per file by default, empty names left out."""
    if splits is None:
        splits = first_split + len(urls) // sources if sources else len(urls)
    width = max(1, splits)
    return [Cell(first_source + i // width, first_split + i % width, u) for i, u in enumerate(urls) if u]


def read_grid(spark: SparkSession, cells: list[Cell], read=None) -> DataFrame:
    """(source, split, key, value) of the files of a grid; ``read`` (spark, paths) -> (key, value), lines by default.

    Files of one cell of the grid are read together; where files have equal splits, their rows are told apart by source.
    """
    groups: dict = {}
    for c in cells:
        groups.setdefault((c.source, c.split), []).append(c.url)
    frames = [(read or read_lines)(spark, urls).select(F.lit(i).alias("source"), F.lit(j).alias("split"), "key", "value") for (i, j), urls in groups.items()]
    return union_sources(*frames) if frames else spark.createDataFrame([], "source int, split int, key bigint, value string")


def read_urls(spark: SparkSession, urls: list[str]) -> DataFrame:
    """(url, content) of http and https addresses, fetched by the workers, a task for each; others are refused."""
    odd = [u for u in urls if urlparse(u).scheme not in ("http", "https")]
    if odd:
        raise ValueError(f"not http or https: {odd[:3]}")
    ship(spark)

    def run(batches):
        from urllib.request import urlopen

        for batch in batches:
            for u in batch.column("url").to_pylist():
                with urlopen(u, timeout=60) as answer:
                    yield pa.RecordBatch.from_arrays([pa.array([u]), pa.array([answer.read()], pa.binary())], names=["url", "content"])

    return spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, len(urls)), "url").mapInArrow(run, "url string, content binary")


def union_sources(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, columns by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
