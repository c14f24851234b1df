"""Grouped objects, job farms, and times of a run's log."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.mapreduce import map_data, reducemap_data
from millrace.operators.partition import by_mod
from millrace.storage import ship


#: What is kept of a topic, and how two such objects are added up.
TOPIC = "n_docs bigint, n_chars bigint, longest bigint, shortest bigint, n_sizes bigint"


def document_topics(docs: DataFrame) -> DataFrame:
    """Per (lang, source) an accumulated object: documents, characters, longest and shortest text, different sizes."""
    size = F.length("text")
    return docs.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("n_chars"), F.max(size).cast("bigint").alias("longest"), F.min(size).cast("bigint").alias("shortest"), F.count_distinct("n_chars").alias("n_sizes")
    )


def map_documents(docs: DataFrame, parse: Callable[[str], dict], schema: str, text: str = "text", setup: Callable | None = None) -> DataFrame:
    """(topic, fields of ``schema``) of every document: ``parse`` (text) -> {topic: tuple of fields}, by Arrow batches.

    ``setup`` is called in each task first, to load what ``parse`` needs. Null texts have no topics.
    """
    pairs = docs.select(F.lit(0).alias("key"), F.col(text).alias("value")).where(F.col(text).isNotNull())
    return map_data(pairs, lambda _, t: ((k, *fields) for k, fields in parse(t).items()), f"topic string, {schema}", setup=setup)


#: States a task holds before it hands them on.
STATES_AT = 10_000


def aggregate_objects(df: DataFrame, key: str, start: Callable, add: Callable, finish: Callable, schema: str, merge: Callable | None = None) -> DataFrame:
    """An accumulator of one's own per key: ``finish(key, state)`` gives rows; state is ``add(state, row)`` by row.

    ``merge(state, state)`` adds two states up: with it, each task accumulates the rows it reads and only states are dealt
    out, so no task reads all rows of a key. Rows have Python's values then. Without, a task reads all rows of a key, in frames.
    """
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    names = StructType.fromDDL(schema).fieldNames()
    if merge:
        states = _states(df, key, start, add)
        return reducemap_data(states, lambda _, found: [reduce(merge, map(cloudpickle.loads, found))], finish, states.schema, schema)

    def run(group: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = start()
        for f in frames:
            for row in f.itertuples(index=False):
                state = add(state, row)
        yield pd.DataFrame(list(finish(group[0], state)), columns=names)

    run.__annotations__ = {"group": tuple[object, ...], "frames": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return df.groupBy(key).applyInPandas(run, schema)


def _states(df: DataFrame, key: str, start: Callable, add: Callable) -> DataFrame:
    """(key, value): a pickled state of a key's rows for each task that has some, or more of them where keys are many."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructType

    schema = StructType().add("key", df.schema[key].dataType).add("value", BinaryType())
    arrow, columns = to_arrow_schema(schema), df.columns

    def emit(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, arrow[0].type), pa.array(map(cloudpickle.dumps, held.values()), pa.binary())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        row_of = namedtuple("Row", columns, rename=True)
        for b in batches:
            values = [c.to_pylist() for c in b.columns]
            for k, *row in zip(values[0], *values[1:]):
                held[k] = add(held[k] if k in held else start(), row_of(*row))
                if len(held) >= STATES_AT:
                    yield emit(held)
                    held = {}
        if held:
            yield emit(held)

    return df.select(F.col(key).alias("key"), "*").mapInArrow(run, schema)


#: What a farm may run, by name. Text that comes with the data is never a command.
JOBS: dict[str, Callable[[int], float]] = {"square": lambda x: float(x * x), "halves": lambda x: float(x.bit_length()), "triangle": lambda x: x * (x + 1) / 2}


def farm(spark: SparkSession, tasks: list[tuple[str, int]], splits: int = 300) -> DataFrame:
    """(task, job, argument, result): each task by its own number's split; unknown jobs are refused before any runs."""
    unknown = {name for name, _ in tasks} - JOBS.keys()
    if unknown:
        raise ValueError(f"no such jobs: {sorted(unknown)}")
    table = spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(tasks)], "key bigint, job string, argument bigint")
    table = by_mod(table, max(1, min(splits, len(tasks))))
    ship(spark)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"task": f["key"], "job": f["job"], "argument": f["argument"], "result": [JOBS[n](int(x)) for n, x in zip(f["job"], f["argument"])]})

    return table.mapInPandas(run, "task bigint, job string, argument bigint, result double")


def intervals(events: DataFrame, group: str, at: str = "ts") -> DataFrame:
    """Per group: first and last time, seconds between, and how many."""
    sec = lambda c: F.unix_micros(c.cast("timestamp"))
    return events.groupBy(group).agg(F.min(at).alias("first_ts"), F.max(at).alias("last_ts"), F.count(F.lit(1)).alias("n")).withColumn("seconds", (sec(F.col("last_ts")) - sec(F.col("first_ts"))) / F.lit(1e6))


#: What the ``\\s*$`` of the patterns takes off an end: spaces, and a line end that ``.`` doesn't match.
ENDS = " \t\n\x0b\f\r\x85\u2028\u2029"


def _trimmed(text):
    return F.when(reduce(Column.__or__, [text.endswith(c) for c in ENDS]), F.rtrim(text, F.lit(ENDS))).otherwise(text)


def log_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ts, level, message) of lines ``YYYY-MM-DD HH:MM:SS,mmm: LEVEL: message``; others are left out.

    The pattern is matched once a line; where it matches, its parts stand between known places.
    """
    pattern = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}): (\w+): (.*?)\s*$"
    line = F.col(column)
    colon = F.locate(":", line, 26)  # after the level
    at = F.replace(F.substring(line, 1, 23), F.lit(","), F.lit(".")).cast("timestamp")
    level, message = F.substring(line, F.lit(26), colon - 26), F.substring(_trimmed(line), colon + 2, F.lit(1 << 30))
    return lines.where(line.rlike(pattern)).select(at.alias("ts"), level.alias("level"), message.alias("message"))


#: Messages of a run's log that name a task of a dataset, when it is given out and when it is reported.
ASSIGNED, REPORTED = r"^Assigning.*: (\w+), (\d+)\s*$", r"^Slave \d+ report.*: (\w+), (\d+)\s*$"


def _tasks(messages: DataFrame) -> DataFrame:
    """(ts, begun, dataset, task) of the messages that name a task, after their last colon."""
    message = F.col("message")
    name = _trimmed(F.substring_index(message, ": ", -1))
    found = messages.where(message.rlike(f"{ASSIGNED}|{REPORTED}"))
    return found.select("ts", message.startswith("Assigning").alias("begun"), F.substring_index(name, ", ", 1).alias("dataset"), F.substring_index(name, ", ", -1).alias("task"))


def task_times(messages: DataFrame) -> DataFrame:
    """(dataset, tasks, mean_seconds): of each task from when it was last assigned to its last report."""
    each = _tasks(messages).groupBy("dataset", "task").agg(F.max(F.when(F.col("begun"), F.col("ts"))).alias("first"), F.max(F.when(~F.col("begun"), F.col("ts"))).alias("last")).where("first is not null")
    sec = lambda c: F.unix_micros(F.col(c)) / F.lit(1e6)
    # a task without a later report takes no time yet
    return each.groupBy("dataset").agg(F.count(F.lit(1)).alias("tasks"), F.avg(F.greatest(F.lit(0.0), F.coalesce(sec("last") - sec("first"), F.lit(0.0)))).alias("mean_seconds"))


def dataset_times(messages: DataFrame) -> DataFrame:
    """(dataset, first_ts, last_ts, n, seconds) over all messages that name a task of a dataset."""
    return intervals(_tasks(messages).select("ts", "dataset"), "dataset")
