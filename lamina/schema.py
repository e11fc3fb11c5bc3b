"""The schema mini-language: "a:int,b:[str],c:{x:long,y:<str,double>}" and its transformations.

Names that are no identifiers stand in back quotes. Python's int and float are 64 bits wide; the text "int" has 32.
Unsigned types have no counterpart and widen to the next signed one. All columns are nullable.
"""

from __future__ import annotations

import datetime
import decimal
import re
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema

from .errors import SchemaError

_SIMPLE: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "boolean": T.BooleanType(), "byte": T.ByteType(), "int8": T.ByteType(), "short": T.ShortType(),
    "int16": T.ShortType(), "int": T.IntegerType(), "int32": T.IntegerType(), "long": T.LongType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "ubyte": T.ShortType(), "uint16": T.IntegerType(), "ushort": T.IntegerType(), "uint32": T.LongType(),
    "uint": T.LongType(), "uint64": T.DecimalType(20, 0), "ulong": T.DecimalType(20, 0), "float": T.FloatType(), "float32": T.FloatType(),
    "double": T.DoubleType(), "float64": T.DoubleType(), "str": T.StringType(), "string": T.StringType(), "bytes": T.BinaryType(),
    "binary": T.BinaryType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampNTZType(), "null": T.NullType(),
}
_PYTHON: dict[type, T.DataType] = {
    bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(),
    datetime.date: T.DateType(), datetime.datetime: T.TimestampNTZType(), decimal.Decimal: T.DecimalType(38, 18),
}
_NAMES = {T.BooleanType: "bool", T.ByteType: "byte", T.ShortType: "short", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "str", T.BinaryType: "bytes", T.DateType: "date", T.TimestampNTZType: "datetime", T.NullType: "null"}
_WORD = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_]*)")
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*$")


class _Reader:
    """Reads names, types and signs from left to right."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, what: str) -> SchemaError:
        return SchemaError(f"{what} at position {self.at} of {self.text!r}")

    def blank(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def peek(self) -> str:
        self.blank()
        return self.text[self.at : self.at + 1]

    def take(self, sign: str) -> bool:
        if self.peek() == sign:
            self.at += 1
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise self.fail(f"{sign!r} expected")

    def name(self) -> str:
        if self.take("`"):
            out = ""
            while True:
                end = self.text.find("`", self.at)
                if end < 0:
                    raise self.fail("back quote expected")
                out += self.text[self.at : end]
                self.at = end + 1
                if self.text[self.at : self.at + 1] != "`":
                    return out
                out += "`"
                self.at += 1
        self.blank()
        m = re.compile(r"[^\W\d]\w*").match(self.text, self.at)
        if not m:
            raise self.fail("a name expected")
        self.at = m.end()
        return m[0]

    def kind(self) -> T.DataType:
        if self.take("["):
            inner = self.kind()
            self.need("]")
            return T.ArrayType(inner)
        if self.take("{"):
            inner = self.fields("}")
            self.need("}")
            return T.StructType(inner)
        if self.take("<"):
            key = self.kind()
            self.need(",")
            value = self.kind()
            self.need(">")
            return T.MapType(key, value)
        m = _WORD.match(self.text, self.at)
        if not m:
            raise self.fail("a type expected")
        self.at, word = m.end(), m[1].lower()
        args: list[str] = []
        if self.take("("):
            end = self.text.find(")", self.at)
            if end < 0:
                raise self.fail("')' expected")
            args, self.at = [a.strip() for a in self.text[self.at : end].split(",")], end + 1
        if word == "decimal":
            return T.DecimalType(int(args[0]) if args else 38, int(args[1]) if len(args) > 1 else 0)
        if word == "timestamp" and len(args) == 2:
            return T.TimestampType()
        if word not in _SIMPLE:
            raise self.fail(f"unknown type {word!r}")
        return _SIMPLE[word]

    def fields(self, stop: str = "") -> list[T.StructField]:
        out: list[T.StructField] = []
        while self.peek() and self.peek() not in stop:
            name = self.name()
            self.need(":")
            out.append(T.StructField(name, self.kind()))
            if not self.take(","):
                break
        return out


def parse_type(kind: Any) -> T.DataType:
    """Of a mini-language text, a Python type, an Arrow or a Spark type."""
    if isinstance(kind, T.DataType):
        return kind
    if isinstance(kind, pa.DataType):
        return from_arrow_type(kind)
    if isinstance(kind, type) and kind in _PYTHON:
        return _PYTHON[kind]
    if isinstance(kind, str):
        reader = _Reader(kind)
        out = reader.kind()
        if reader.peek():
            raise reader.fail("end expected")
        return out
    raise SchemaError(f"{kind!r} is no type")


def _checked(fields: list[T.StructField]) -> T.StructType:
    if not fields:
        raise SchemaError("a schema must not be empty")
    names = [f.name for f in fields]
    if len(set(names)) < len(names):
        raise SchemaError(f"doubled columns in {names}")
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


def parse_schema(schema: Any) -> T.StructType:
    """Of a text, a dict or pairs of name and type, an Arrow schema, a Spark schema or a DataFrame."""
    if isinstance(schema, DataFrame):
        schema = schema.schema
    if isinstance(schema, T.StructType):
        return _checked(schema.fields)
    if isinstance(schema, pa.Schema):
        return _checked([T.StructField(f.name, from_arrow_type(f.type)) for f in schema])
    if isinstance(schema, str):
        reader = _Reader(schema)
        fields = reader.fields()
        if reader.peek():
            raise reader.fail("end expected")
        return _checked(fields)
    if isinstance(schema, dict):
        schema = schema.items()
    if isinstance(schema, Iterable):
        fields: list[T.StructField] = []
        for part in schema:
            fields += parse_schema(part).fields if isinstance(part, str) else [T.StructField(part[0], parse_type(part[1]))]
        return _checked(fields)
    raise SchemaError(f"{schema!r} is no schema")


def quote(name: str) -> str:
    return name if _PLAIN.match(name) else "`" + name.replace("`", "``") + "`"


def format_type(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"[{format_type(kind.elementType)}]"
    if isinstance(kind, T.StructType):
        return "{" + format_schema(kind) + "}"
    if isinstance(kind, T.MapType):
        return f"<{format_type(kind.keyType)},{format_type(kind.valueType)}>"
    if isinstance(kind, T.DecimalType):
        return f"decimal({kind.precision},{kind.scale})"
    if isinstance(kind, T.TimestampType):
        return "timestamp(us,UTC)"
    return _NAMES.get(type(kind)) or kind.simpleString()


def format_schema(schema: T.StructType) -> str:
    return ",".join(f"{quote(f.name)}:{format_type(f.dataType)}" for f in schema.fields)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def transform_schema(base: T.StructType, change: Any, **params: Any) -> T.StructType:
    """The schema that a change of base gives.

    "*" is all of base; further fields after a comma are new columns; "+a:int" sets a column's type in place or adds
    it; "-a" removes a column that must exist, "~a" one that may. A list of changes is read as one; a callable gets
    base and the parameters. A change without "*" is a whole schema.
    """
    if callable(change) and not isinstance(change, T.DataType):
        return transform_schema(base, change(base, **params))
    if isinstance(change, (list, tuple)) and all(isinstance(c, str) for c in change):
        change = ",".join(change)
    if not isinstance(change, str):
        return parse_schema(change)
    reader, fields = _Reader(change), {}

    def put(new: list[T.StructField], replace: bool) -> None:
        for f in new:
            if f.name in fields and not replace:
                raise SchemaError(f"column {f.name} exists in {list(fields)}")
            fields[f.name] = f.dataType

    while True:
        if reader.take("*"):
            put(base.fields, False)
        elif reader.peek() in ("+", "-", "~"):
            sign = reader.peek()
            reader.take(sign)
            while True:
                if sign == "+":
                    put([T.StructField(reader.name(), _typed(reader))], True)
                else:
                    name = reader.name()
                    if sign == "-" and name not in fields:
                        raise SchemaError(f"no column {name} in {list(fields)}")
                    fields.pop(name, None)
                if not reader.take(","):
                    break
        elif reader.peek():
            put([T.StructField(reader.name(), _typed(reader))], False)
        if reader.take(","):
            continue
        if reader.peek() not in ("+", "-", "~"):
            break
    if reader.peek():
        raise reader.fail("end expected")
    return _checked([T.StructField(n, k) for n, k in fields.items()])


def _typed(reader: _Reader) -> T.DataType:
    reader.need(":")
    return reader.kind()


def same_schema(a: T.StructType, b: T.StructType) -> bool:
    """Names, types and order; nullability does not count."""
    return format_schema(a) == format_schema(b)


SchemaChange = str | list[str] | T.StructType | dict[str, Any] | Callable[..., Any]
