"""Programs: one-shot, producer and consumer, generator with callbacks, bypass."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Iterator
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.rng import array_generator, generator
from millrace.operators.mapreduce import map_data, reduce_data
from millrace.session import Options, session
from millrace.sources.lines import read_lines
from millrace.sources.pairs import write_text
from millrace.storage import clean


class Program:
    """A map and a reduce over input files; override what differs."""

    map_schema = "key string, value bigint"
    reduce_schema = "key string, value bigint"
    combine: Callable | None = None
    #: (frame, n) -> frame dealt to n partitions, as those of ``operators.partition``; by Spark's hash of the key if None.
    partition: Callable | None = None
    #: Called in each task before its first pair, to load what maps and reduces look up; what it sets is not shared.
    setup: Callable | None = None

    def __init__(self, spark: SparkSession, args: list[str] = (), options: Options | None = None):
        self.spark, self.args, self.options = spark, list(args), options or Options()

    def map(self, key, value) -> Iterator[tuple]:
        yield key, value

    def reduce(self, key, values) -> Iterator:
        yield from values

    def random(self, *offsets: int):
        """A generator that the job's seed and the offsets determine."""
        return generator(self.options.seed, *offsets)

    def numpy_random(self, *offsets: int):
        """The same of numpy, with other draws; left-out offsets are not zeros."""
        return array_generator(self.options.seed, *offsets)

    def input_data(self) -> DataFrame:
        """All arguments but the last are input files."""
        return read_lines(self.spark, self.args[:-1])

    def output_dir(self) -> str | None:
        return self.args[-1] if self.args else None

    def plan(self) -> DataFrame:
        mapped = map_data(self.input_data(), self.map, self.map_schema, self.options.splits, self.partition, self.combine, self.setup)
        return reduce_data(mapped, self.reduce, self.reduce_schema, setup=self.setup)

    def run(self) -> int:
        out = self.plan()
        if self.output_dir():
            write_text(out, self.output_dir())
        else:
            out.write.format("noop").mode("overwrite").save()
        return 0

    def bypass(self) -> int:
        """Run with no data flow at all."""
        raise NotImplementedError

    @classmethod
    def update_parser(cls, parser: argparse.ArgumentParser) -> argparse.ArgumentParser:
        return parser

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "spark"}


def main(program: type[Program], argv: list[str], spark: SparkSession | None = None) -> int:
    """Parse options, run the program, return its exit code. Every field of ``Options`` is an option of the command."""
    parser = argparse.ArgumentParser()
    for f in fields(Options):
        name = f"--{f.name.replace('_', '-')}"
        if isinstance(f.default, bool):
            parser.add_argument(name, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            parser.add_argument(name, type=int if isinstance(f.default, int) else str, default=f.default)
    parser.add_argument("--bypass", action="store_true")
    parser.add_argument("args", nargs="*")
    got = program.update_parser(parser).parse_args(argv)
    options = Options(**{f.name: getattr(got, f.name) for f in fields(Options)})
    own = spark is None
    made = program(spark or session(options), got.args, options)
    made.parsed = got
    try:
        return made.bypass() if got.bypass else made.run() or 0
    finally:
        if own and not options.keep_scratch:
            clean(made.spark)


def iterate(steps: Iterator[tuple[DataFrame, Callable[[DataFrame], bool | None]]]) -> int:
    """Run a generator of (frame, callback) until a callback returns False; returns the number of steps.

    A callback that returns None goes on. The generator is asked for the next step only after the callback.
    """
    n = 0
    for frame, callback in steps:
        n += 1
        if callback(frame) is False:
            break
    return n


def produce_consume(producer: Callable[[], list[DataFrame]], consumer: Callable[[DataFrame], bool]) -> int:
    """Ask for frames and consume them until the producer has none or the consumer returns what counts as false."""
    n = 0
    while frames := producer():
        for frame in frames:
            n += 1
            if not consumer(frame):
                return n
    return n
