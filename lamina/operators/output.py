"""What ends a pipeline: comparison, printing, and local forms of a frame."""

from __future__ import annotations

import math
from collections.abc import Iterator
from html import escape
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T

from ..errors import SchemaError
from ..schema import format_schema, parse_schema, same_schema
from .relational import need, select_columns


def frame(spark: Any, data: Any, schema: Any = None) -> DataFrame:
    """A DataFrame of rows, dicts, a pandas or Arrow frame, or of itself; rows need a schema."""
    import pandas as pd

    from .relational import enforce

    if isinstance(data, DataFrame):
        return data if schema is None else enforce(data, schema)
    if isinstance(data, pa.Table):
        made = spark.createDataFrame(_widened(data))
        return made if schema is None else enforce(made, schema)
    if isinstance(data, pd.DataFrame):
        want = parse_schema(schema) if schema is not None else None
        if want is not None:
            need_all = [n for n in want.names if n not in data.columns]
            if need_all:
                raise SchemaError(f"no columns {need_all}")
        if want is None and data.empty and not len(data.columns):
            raise SchemaError("a schema must not be empty")
        table = pa.Table.from_pandas(data, preserve_index=False)
        made = spark.createDataFrame(_widened(table))
        return made if want is None else enforce(made, want)
    if schema is None:
        raise SchemaError("rows need a schema")
    want = parse_schema(schema)
    rows = [[_plain(v) for v in (([r.get(n) for n in want.names]) if isinstance(r, dict) else r)] for r in data]
    return spark.createDataFrame(rows, want, verifySchema=False) if rows else spark.createDataFrame([], want)


def _plain(v: Any) -> Any:
    """NaN and NaT are null at this boundary."""
    if isinstance(v, float) and math.isnan(v) or type(v).__name__ == "NaTType":
        return None
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) and not hasattr(v, "_fields") else v


def _widened(table: pa.Table) -> pa.Table:
    """Unsigned integers as the next signed kind."""
    wide = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}
    schema = pa.schema([pa.field(f.name, wide.get(f.type, f.type)) for f in table.schema])
    return table if schema == table.schema else table.cast(schema)


def same(df: DataFrame, other: Any, schema: Any = None, *, digits: int = 8, check_order: bool = False, check_schema: bool = True, check_content: bool = True, throw: bool = False) -> bool:
    """Whether frames hold the same rows, in any order unless told; nulls are equal, numbers to some digits.

    For small frames: both are brought to the driver.
    """
    two = frame(df.sparkSession, other, schema)

    def fail(what: str) -> bool:
        if throw:
            raise AssertionError(what)
        return False

    if check_schema and not same_schema(df.schema, two.schema):
        return fail(f"{format_schema(df.schema)} is not {format_schema(two.schema)}")
    if not check_content:
        return True

    def tidy(v: Any) -> Any:
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, digits)
        if isinstance(v, dict):
            return tuple(sorted((k, tidy(x)) for k, x in v.items()))
        return tuple(map(tidy, v)) if isinstance(v, (list, tuple)) else v

    a, b = ([tuple(map(tidy, r)) for r in d.collect()] for d in (df, two))
    if not check_order:
        a, b = sorted(a, key=repr), sorted(b, key=repr)
    return a == b or fail(f"{a[:20]} is not {b[:20]}")


def assert_eq(df: DataFrame, *others: Any, **options: Any) -> None:
    for o in others:
        same(df, o, throw=True, **options)


def assert_not_eq(df: DataFrame, *others: Any, **options: Any) -> None:
    for o in others:
        if same(df, o, **options):
            raise AssertionError("the frames are the same")


def show(df: DataFrame, n: int = 10, with_count: bool = False, title: str | None = None) -> None:
    if title:
        print(title)
    print(format_schema(df.schema))
    print(df.limit(n).toPandas().to_string(index=False))
    if with_count:
        print(f"{df.count()} rows")


def to_html(df: DataFrame, n: int = 10, with_count: bool = False, title: str | None = None) -> str:
    """What show() prints, as HTML; all values are escaped."""
    parts = [f"<h3>{escape(title)}</h3>"] if title else []
    parts += [f"<code>{escape(format_schema(df.schema))}</code>", df.limit(n).toPandas().to_html(index=False, border=0)]
    return "\n".join(parts + [f"<p>{df.count()} rows</p>"] * with_count)


def head(df: DataFrame, n: int, columns: list[str] | None = None) -> pa.Table:
    """The first rows, local."""
    return (select_columns(df, columns) if columns else df).limit(n).toArrow()


def peek_array(df: DataFrame) -> list:
    row = df.first()
    if row is None:
        raise ValueError("the frame is empty")
    return list(row)


def peek_dict(df: DataFrame) -> dict[str, Any]:
    return dict(zip(df.columns, peek_array(df), strict=True))


def _safe(v: Any) -> Any:
    """Plain Python values alone: structs are dicts, bytes are bytes, NaN is null."""
    if isinstance(v, Row):
        return {k: _safe(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: _safe(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_safe(x) for x in v]
    return bytes(v) if isinstance(v, bytearray) else None if isinstance(v, float) and math.isnan(v) else v


def as_array_iterable(df: DataFrame, columns: list[str] | None = None, type_safe: bool = False) -> Iterator[list]:
    """Rows, a partition at a time."""
    for r in (select_columns(df, columns) if columns else df).toLocalIterator():
        yield [_safe(v) for v in r] if type_safe else list(r)


def as_array(df: DataFrame, columns: list[str] | None = None, type_safe: bool = False) -> list[list]:
    found = (select_columns(df, columns) if columns else df).collect()
    return [[_safe(v) for v in r] if type_safe else list(r) for r in found]


def as_dict_iterable(df: DataFrame, columns: list[str] | None = None) -> Iterator[dict[str, Any]]:
    names = columns or df.columns
    need(df, names)
    return (dict(zip(names, r, strict=True)) for r in as_array_iterable(df, names))


def as_dicts(df: DataFrame, columns: list[str] | None = None) -> list[dict[str, Any]]:
    return list(as_dict_iterable(df, columns))


def schema_text(df: DataFrame) -> str:
    return format_schema(T.StructType(df.schema.fields))
