"""map, reduce and fused reduce-map over (key, value) rows, native or by Python generators.

Native forms are DataFrame functions or aggregate columns, which Catalyst optimises. Python generators run on
Arrow batches, and their reducers see a group's values as they stream in. ``outdir`` keeps a result's pairs as files
in one of the pair formats; the result is staged then, so that it is computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.operators.partition import by_hash
from millrace.sources.pairs import TEXT, WRITERS
from millrace.storage import ship, stage

Partition = Callable[[DataFrame, int], DataFrame]


def _type(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def _dealt(df: DataFrame, splits: int | None, partition: Partition | None) -> DataFrame:
    return df if splits is None else (partition or by_hash)(df, splits)


def _kept(df: DataFrame, outdir: str | None, form: str) -> DataFrame:
    if outdir is None:
        return df
    df = stage(df, "kept")
    WRITERS[form](df, outdir)
    return df


def arrow_batches(pairs: Iterable, schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list = []
    for pair in pairs:
        held.append(pair)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def map_data(
    df: DataFrame, fn: Callable, schema: str | None = None, splits: int | None = None, partition: Partition | None = None, combiner: Callable | None = None,
    setup: Callable | None = None, outdir: str | None = None, form: str = TEXT,
) -> DataFrame:
    """``fn``: DataFrame -> DataFrame with columns key, value; or, with ``schema``, a generator (key, value) -> pairs.

    ``combiner``: a generator (key, values) -> values that sums up inside each task before rows are dealt out; it
    must be associative with the reducer. ``setup`` is called in each task before its first pair. ``splits``: partitions
    of the result, by key unless ``partition`` says. ``outdir``, ``form``: where and how pairs are kept besides.
    """
    if schema is None:
        return _kept(_dealt(fn(df), splits, partition), outdir, form)
    arrow = to_arrow_schema(_type(schema))
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup:
            setup()
        pairs = (out for b in batches for k, v in zip(b.column("key").to_pylist(), b.column("value").to_pylist()) for out in fn(k, v))
        yield from arrow_batches(_combined(pairs, combiner) if combiner else pairs, arrow)

    return _kept(_dealt(df.select("key", "value").mapInArrow(run, schema), splits, partition), outdir, form)


#: Pairs a task holds before it combines them.
COMBINE_AT = 200_000


def _combined(pairs: Iterable, combiner: Callable) -> Iterator[tuple]:
    groups: dict = {}
    n = 0
    for k, v in pairs:
        if k in groups:
            groups[k].append(v)
        else:
            groups[k] = [v]
        n += 1
        if n >= COMBINE_AT:
            groups = {k: vs if len(vs) == 1 else list(combiner(k, vs)) for k, vs in groups.items()}
            n = sum(map(len, groups.values()))
            if n > COMBINE_AT // 2:  # nothing more to gain: pass on
                yield from ((k, v) for k, vs in groups.items() for v in vs)
                groups, n = {}, 0
    for k, vs in groups.items():
        for v in combiner(k, vs):
            yield k, v


def _grouped(df: DataFrame, produce: Callable[[object, Iterator], Iterable], schema: str | StructType, setup: Callable | None) -> DataFrame:
    """Rows of ``produce`` (key, values) for each key. Keys meet by Spark's hash and are sorted in their task, which goes
    through them in one pass of Arrow batches: a group costs no batch of its own, and its values stream."""
    arrow = to_arrow_schema(_type(schema))
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def outputs() -> Iterator:
            begun = False
            pairs = ((_NAN if k != k else k, v) for b in batches for k, v in zip(b.column("key").to_pylist(), b.column("value").to_pylist()))
            for key, group in groupby(pairs, itemgetter(0)):
                if setup and not begun:
                    begun = True
                    setup()
                yield from produce(key, (v for _, v in group))

        yield from arrow_batches(outputs(), arrow)

    return df.select("key", "value").repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


#: One object, as no two of its kind are equal, but keys that are not a number are one group.
_NAN = float("nan")


def reduce_data(
    df: DataFrame, fn: Callable | list[Column], schema: str | None = None, splits: int | None = None, partition: Partition | None = None, setup: Callable | None = None,
    sort_values: bool = False, outdir: str | None = None, form: str = TEXT,
) -> DataFrame:
    """One reduction per key; the key is put back and cannot be changed. Each partition is sorted by key, or with
    ``sort_values`` by key and value.

    ``fn``: aggregate columns, or, with ``schema``, a generator (key, values) -> 0..n values, where values is an
    iterator of Python's values (None for null) that may be read once, in no given order. Other parameters are as for
    ``map_data``.
    """
    if schema is None:
        out = df.groupBy("key").agg(*fn)
    else:
        out = _grouped(df, lambda k, vs: ((k, out) for out in fn(k, vs)), schema, setup)
    return _kept(_dealt(out, splits, partition).sortWithinPartitions("key", *(["value"] if sort_values else [])), outdir, form)


def reducemap_data(
    df: DataFrame, reducer: Callable | list[Column], mapper: Callable, reduce_schema: str | None = None, map_schema: str | None = None, splits: int | None = None,
    partition: Partition | None = None, setup: Callable | None = None, outdir: str | None = None, form: str = TEXT,
) -> DataFrame:
    """Reduce, then map the reduced pairs with no exchange between. Parameters are as for ``map_data``."""
    if reduce_schema is None:
        return _kept(_dealt(mapper(df.groupBy("key").agg(*reducer)), splits, partition), outdir, form)
    reduced = _grouped(df, lambda k, vs: (out for v in reducer(k, vs) for out in mapper(k, v)), map_schema, setup)
    return _kept(_dealt(reduced, splits, partition), outdir, form)


def with_splits(df: DataFrame) -> DataFrame:
    """``df`` with the number of the partition that each row is in."""
    return df.withColumn("split", F.spark_partition_id())
