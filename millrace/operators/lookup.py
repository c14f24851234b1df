"""Joins with a small side, sized before it is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; with more, the join is shuffled.
BROADCAST_ROWS = 1_000_000


def sized(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``limit`` rows."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def lookup(df: DataFrame, small: DataFrame, on: list[str], value: str, default, first: bool = False) -> DataFrame:
    """``df`` with ``value`` from ``small`` by equal ``on`` columns, ``default`` where there is none.

    Of several values of a key the greatest counts, so rows are never multiplied. Spark sizes the join as it runs:
    the small side is grouped first, and adaptive execution broadcasts what turns out small. By then ``df`` may have been
    dealt out already; with ``first`` the small side is counted before, and ``df`` stays as it is dealt where that is small.
    """
    grouped = small.groupBy(*on).agg(F.max(value).alias(value))
    joined = df.join(sized(grouped) if first else grouped, on, "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def both_ways(relation: DataFrame, source: str = "s", target: str = "t", name: str = "name") -> DataFrame:
    """A relation and its inverse, whose names end in ``_inv``; where both exist the given direction holds."""
    back = relation.select(F.col(target).alias(source), F.col(source).alias(target), F.concat(F.col(name), F.lit("_inv")).alias(name))
    ranked = relation.select(source, target, name, F.lit(0).alias("_r")).unionByName(back.withColumn("_r", F.lit(1)))
    return ranked.groupBy(source, target).agg(F.min(F.struct("_r", name)).alias("_b")).select(source, target, F.col(f"_b.{name}").alias(name))


def tagged_join(left: DataFrame, right: DataFrame, on: str | Column, how: str = "inner") -> DataFrame:
    """Two sources brought to one key, as a reduce over tagged values would; Spark picks the strategy."""
    return left.join(right, on, how)
