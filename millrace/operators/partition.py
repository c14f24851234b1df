"""Partitioners: rows to numbered partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.digest import md5_mod, mod
from millrace.storage import free_name, ship, stage


def by_number(df: DataFrame, n: int, number: Column) -> DataFrame:
    """Row with number p goes to partition p, 0 <= p < n."""
    return df.repartitionById(n, number.cast("int"))


def by_md5(df: DataFrame, n: int, key: str = "key") -> DataFrame:
    return by_number(df, n, md5_mod(F.col(key), n)) if n > 1 else df.coalesce(1)


def by_mod(df: DataFrame, n: int, key: str = "key") -> DataFrame:
    return by_number(df, n, mod(F.col(key), n))


def by_hash(df: DataFrame, n: int, key: str = "key") -> DataFrame:
    """Spark's own hash; the fast way where only "equal keys meet" matters."""
    return df.repartition(n, key)


def by_function(df: DataFrame, n: int, fn, key: str = "key", native: bool = False) -> DataFrame:
    """``fn``: a Python function of the key that gives a partition number, run on Arrow batches; with ``native`` a
    function of columns, Column -> Column."""
    if native:
        return by_number(df, n, fn(F.col(key)))
    import pandas as pd

    ship(df.sparkSession)

    def numbers(keys: pd.Series) -> pd.Series:
        return keys.map(fn).astype("int32")

    numbers.__annotations__ = {"keys": pd.Series, "return": pd.Series}
    return by_number(df, n, F.pandas_udf(numbers, "int")(F.col(key)))


def round_robin(df: DataFrame, n: int, order: str) -> DataFrame:
    """i-th row in ``order`` to partition i mod n. Places come from range partitions, not from one sorted task."""
    name = free_name(df, "place")
    placed = with_place(df, order, name)
    return by_number(placed, n, F.col(name) % n).drop(name)


def with_place(df: DataFrame, order: str, name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 0) in the order of ``order``.

    The sorted rows are staged, so that their places are of one and the same sort.
    """
    number, part, size, start = (free_name(df, n) for n in ("number", "part", "size", "start"))
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn(number, F.monotonically_increasing_id())
    # rows of a partition number on from part << 33
    ranged = stage(ranged.withColumn(part, F.shiftright(F.col(number), 33)), "placed")
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(size))
    starts = sizes.select(part, (F.sum(size).over(Window.orderBy(part)) - F.col(size)).alias(start))
    joined = ranged.join(F.broadcast(starts), part)  # a row per partition
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(start) + F.col(number) - F.shiftleft(F.col(part), 33)).alias(name))
