"""Shared storage for tables that cut lineage, and this package's code for Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application; Spark's driver serves the archive."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "millrace.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "millrace")):
            for name in names:
                if name.endswith(".py"):
                    z.write(full := os.path.join(folder, name), os.path.relpath(full, top))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a fresh local one, if all of Spark is here.

    On a cluster no local folder is shared, so an unset folder is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="millrace-"))
    return f"{found.rstrip('/')}/millrace-{app}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("staged", default=())


def stage(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back.

    Lineage ends at the files, so a lost executor costs a reread and no recomputation. The files go with the ``scope``
    that they were staged in, or with the one around it if they are to be kept, and all of them with ``clean``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    if held := _OPEN.get()[: -1 if keep else None]:
        held[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession):
    """What is staged inside is deleted at the end; what outlives it must not read from it."""
    held: list[str] = []
    token = _OPEN.set((*_OPEN.get(), held))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in held:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system API, if it is there."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has staged. Results that were not written elsewhere can't be read after."""
    remove(spark, shared_dir(spark))


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Full names of the part files of a written folder, sorted; works on any Hadoop file system."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(hpath) if s.getPath().getName().startswith("part-"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name
