"""What the operators share: staged tables (see ``millrace.storage``), sizes of partitions, lower case."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.storage import free_name, fresh_path, list_files, remove, scope, shared_dir, stage

__all__ = ["ascii_lower", "free_name", "fresh_path", "list_files", "partitions_for", "remove", "scope", "shared_dir", "stage"]


def partitions_for(spark: SparkSession, n_bytes: float, per_partition: int) -> int:
    """Partitions so that each holds about ``per_partition`` bytes, and no fewer than the session's default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_bytes // per_partition) + 1)


def ascii_lower(col):
    """Lower-case A-Z and nothing else (Spark's ``lower`` folds all of Unicode)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
