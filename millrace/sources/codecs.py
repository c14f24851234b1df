"""Codecs: typed columns to the bytes of pair files and back.

``to_bytes`` and ``from_bytes`` are functions of columns. Strings are UTF-8 and integers decimal text, which Spark does
itself; packed numbers and records, and codecs of a user's own functions, go through Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.functions.digest import key_bytes


@dataclass(frozen=True)
class Codec:
    to_bytes: Callable[[Column], Column]
    from_bytes: Callable[[Column], Column]


#: Bytes as they are.
RAW = Codec(lambda c: c.cast("binary"), lambda c: c)
#: UTF-8; bytes that aren't are an error.
STR = Codec(lambda c: F.encode(c, "UTF-8"), lambda c: F.decode(c, "UTF-8"))
#: Decimal text of a bigint.
INT = Codec(key_bytes, lambda c: c.cast("string").cast("bigint"))


def functions(dumps: Callable[[object], bytes], loads: Callable[[bytes], object], kind: str) -> Codec:
    """A codec of two Python functions, for instance of a message class: ``kind`` is the type of what ``loads`` gives."""

    def out(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else dumps(v) for v in values.to_pylist()], pa.binary())

    def decoder(c: Column) -> Column:
        arrow = to_arrow_type(T._parse_datatype_string(kind))  # here, as workers have no session to parse with

        def back(values: pa.Array) -> pa.Array:
            return pa.array([None if v is None else loads(v) for v in values.to_pylist()], arrow)

        back.__annotations__ = {"values": pa.Array, "return": pa.Array}
        return F.arrow_udf(back, kind)(c)

    out.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return Codec(lambda c: F.arrow_udf(out, "binary")(c), decoder)


def primitive(form: str, kind: str | None = None) -> Codec:
    """One number in a form of Python's ``struct``, as ``>I``; read as bigint, or as double for ``f`` and ``d``."""
    number = float if form[-1] in "efd" else int
    return functions(lambda v: struct.pack(form, number(v)), lambda b: struct.unpack(form, b)[0], kind or ("double" if number is float else "bigint"))


def record(form: str, names: list[str], kinds: list[str]) -> Codec:
    """A record in a form of Python's ``struct``, as a struct of fields ``names`` of Spark types ``kinds``."""
    kind = f"struct<{','.join(f'`{n}`:{k}' for n, k in zip(names, kinds))}>"
    return functions(lambda row: struct.pack(form, *(row[n] for n in names)), lambda b: dict(zip(names, struct.unpack(form, b))), kind)


def codec_of(kind: T.DataType) -> Codec:
    """The codec of a column's type: bytes, strings or integers."""
    if isinstance(kind, T.BinaryType):
        return RAW
    if isinstance(kind, T.StringType):
        return STR
    if isinstance(kind, T.IntegralType):
        return INT
    raise TypeError(f"name a codec for {kind.simpleString()}")
