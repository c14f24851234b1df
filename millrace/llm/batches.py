"""Arrow batches of (key columns, text) cut to bounded pieces, for operators that run in Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from millrace.storage import ship as _ship

#: Texts of at most so many bytes are worked on at once; a single longer text is a piece of its own.
PIECE_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


_MODEL: dict = {}


def built(tag: str, make: Callable):
    """The model of ``tag`` in this worker, made if it isn't there. A worker holds one at a time, whatever the operator."""
    if tag not in _MODEL:
        _MODEL.clear()
        release()
        _MODEL[tag] = make()
    return _MODEL[tag]


def release() -> None:
    """Give freed memory back to the system, which Arrow's pool and the C library's heap would keep in a reused worker."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def ship(spark) -> None:
    """Make this package importable in Python workers, and Spark's Arrow batches no larger than pieces.

    Spark bounds a batch by 64 MB and 10,000 rows; a session whose bound was set by its user keeps it.
    """
    _ship(spark)
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_CONF):
        spark.conf.set(BATCH_CONF, str(PIECE_BYTES))


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    col = batch.column(text)
    if not len(col):
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def map_pieces(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], dict], schema: str, limit: int = PIECE_BYTES) -> DataFrame:
    """``df`` through ``fn``, which turns a piece into columns by name, as Arrow arrays or lists, in ``schema``'s order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text, limit):
                out = fn(piece)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in arrow for x in (out[f.name],)], schema=arrow)
                del out
        release()

    return df.mapInArrow(run, schema)


def filter_pieces(df: DataFrame, text: str, keep: Callable[[list], list]) -> DataFrame:
    """The rows of ``df``, all columns as they are, for which ``keep`` (texts -> flags) holds."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text):
                yield piece.filter(pa.array(keep(piece.column(text).to_pylist()), pa.bool_()))
        release()

    return df.mapInArrow(run, df.schema)
