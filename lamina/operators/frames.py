"""What a user function takes and gives, told by its annotations, and the way from and to Arrow tables."""

from __future__ import annotations

import collections.abc as abc
import inspect
import itertools
import typing
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any, Generic, TypeVar

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..errors import ValidationError

X = TypeVar("X")


class EmptyAwareIterable(Generic[X]):
    """An iterable that tells whether it is empty, and its next item, without using it up."""

    def __init__(self, items: Iterable[X]):
        self._it = iter(items)
        self._ahead: list[X] = list(itertools.islice(self._it, 1))

    @property
    def empty(self) -> bool:
        return not self._ahead

    def peek(self) -> X:
        if not self._ahead:
            raise StopIteration("nothing left")
        return self._ahead[0]

    def __iter__(self) -> Iterator[X]:
        while self._ahead:
            out = self._ahead[0]
            self._ahead = list(itertools.islice(self._it, 1))
            yield out


#: A dict of frames by name, or a list by place, for functions over several frames.
class Frames(dict):
    pass


_NULLABLE = {
    pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype(),
}


def to_pandas(table: pa.Table) -> pd.DataFrame:
    """Integers and truth values with nulls keep their kind."""
    holed = {c.type for c in table.columns if c.null_count and c.type in _NULLABLE}
    return table.to_pandas(types_mapper=lambda t: _NULLABLE[t] if t in holed else None)


def from_pandas(df: pd.DataFrame, schema: pa.Schema) -> pa.Table:
    missing = [n for n in schema.names if n not in df.columns]
    if missing:
        raise ValueError(f"the output lacks {missing}")
    columns = []
    for f in schema:
        s = df[f.name]
        try:
            columns.append(pa.array(s, f.type, from_pandas=True))
        except (pa.ArrowInvalid, pa.ArrowTypeError):
            columns.append(pa.array(s, from_pandas=True).cast(f.type, safe=False))
        if isinstance(columns[-1], pa.ChunkedArray):
            columns[-1] = columns[-1].combine_chunks()
    return pa.table(columns, schema=schema)


def _conform(table: pa.Table, schema: pa.Schema) -> pa.Table:
    missing = [n for n in schema.names if n not in table.column_names]
    if missing:
        raise ValueError(f"the output lacks {missing}")
    return table.select(schema.names).cast(schema)


def _of(annotation: Any) -> tuple[Any, tuple]:
    return typing.get_origin(annotation), typing.get_args(annotation)


def kind_of(annotation: Any) -> str | None:
    """pandas, arrow, lists or dicts, with _iter for iterables; dict, none, spark, session, frames; None for others."""
    if annotation is None or annotation is type(None):
        return "none"
    if annotation is inspect.Parameter.empty or isinstance(annotation, str):
        return None
    if annotation is pd.DataFrame:
        return "pandas"
    if annotation in (pa.Table, pa.RecordBatch):
        return "arrow"
    if getattr(annotation, "__module__", "").partition(".")[0] == "polars" and getattr(annotation, "__name__", "") == "DataFrame":
        return "polars"
    if annotation is DataFrame or inspect.isclass(annotation) and issubclass(annotation, DataFrame):
        return "spark"
    if inspect.isclass(annotation) and issubclass(annotation, SparkSession):
        return "session"
    if annotation is Frames:
        return "frames"
    origin, args = _of(annotation)
    if origin in (abc.Callable, Callable):
        return "callback"
    if origin in (typing.Union, getattr(__import__("types"), "UnionType", None)) and type(None) in args:
        inner = [a for a in args if a is not type(None)]
        return "optional_callback" if inner and kind_of(inner[0]) == "callback" else None
    if annotation in (Callable, abc.Callable, callable):
        return "callback"
    if origin is list and args:
        return {"list": "lists", "dict": "dicts"}.get(_item(args[0]) or "")
    if origin is EmptyAwareIterable and args:
        inner = _item(args[0])
        return {"list": "lists_aware", "dict": "dicts_aware", "pandas": "pandas_aware", "arrow": "arrow_aware", "polars": "polars_aware"}.get(inner or "")
    if origin in (abc.Iterable, abc.Iterator, abc.Generator) and args:
        return {"list": "lists_iter", "dict": "dicts_iter", "pandas": "pandas_iter", "arrow": "arrow_iter", "polars": "polars_iter"}.get(_item(args[0]) or "")
    if origin is dict or annotation is dict:
        return "dict" if origin is None or len(args) != 2 or kind_of(args[1]) not in ("pandas", "arrow", "spark") else f"frames_{kind_of(args[1])}"
    return None


def _item(annotation: Any) -> str | None:
    origin, _ = _of(annotation)
    if annotation is list or origin is list:
        return "list"
    if annotation is dict or origin is dict:
        return "dict"
    return {"pandas": "pandas", "arrow": "arrow", "polars": "polars"}.get(kind_of(annotation) or "")


def rows_of(table: pa.Table) -> Iterator[list]:
    return map(list, zip(*(c.to_pylist() for c in table.columns), strict=True))


def _polars() -> Any:
    """The library, which only functions that are annotated with its frames need."""
    import polars

    return polars


def give(tables: Iterable[pa.Table], kind: str, schema: pa.Schema) -> Any:
    """Tables in the form that an input annotation asks for; whole forms gather all of them."""
    shape, _, way = kind.partition("_")
    parts = {
        "pandas": lambda t: [to_pandas(t)],
        "arrow": lambda t: [t],
        "polars": lambda t: [_polars().from_arrow(t)],
        "lists": rows_of,
        "dicts": lambda t: t.to_pylist(),
    }[shape]
    if way:
        found = (x for t in tables for x in parts(t))
        return EmptyAwareIterable(found) if way == "aware" else found
    held = list(tables)
    whole = pa.concat_tables(held) if held else schema.empty_table()
    return parts(whole)[0] if shape in ("pandas", "arrow", "polars") else list(parts(whole))


def take_back(out: Any, kind: str | None, schema: pa.Schema, batch: int = 4096) -> Iterator[pa.Table]:
    """The tables of a function's result; forms are told by the values where no annotation tells."""
    if out is None or kind == "none":
        return
    if type(out).__module__.partition(".")[0] == "polars":
        out = out.to_arrow()
    if isinstance(out, pd.DataFrame):
        yield from_pandas(out, schema)
    elif isinstance(out, pa.RecordBatch):
        yield _conform(pa.Table.from_batches([out]), schema)
    elif isinstance(out, pa.Table):
        yield _conform(out, schema)
    elif isinstance(out, dict):
        yield pa.Table.from_pylist([{n: out.get(n) for n in schema.names}], schema=schema)
    else:
        held: list = []
        for x in out:
            if isinstance(x, (pd.DataFrame, pa.Table, pa.RecordBatch)) or type(x).__module__.partition(".")[0] == "polars":
                yield from take_back(x, None, schema)
                continue
            held.append(x if isinstance(x, dict) else dict(zip(schema.names, x, strict=True)))
            if len(held) >= batch:
                yield pa.Table.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.Table.from_pylist(held, schema=schema)


def ordered(table: pa.Table, presort: dict[str, bool]) -> pa.Table:
    """Nulls go last, as in the frames that user functions are used to."""
    if not presort or table.num_rows < 2:
        return table
    at = pc.sort_indices(table, sort_keys=[(c, "ascending" if up else "descending") for c, up in presort.items()], null_placement="at_end")
    return table.take(at)


@dataclass
class Signature:
    """Of a user function: parameters that take frames, what takes the callback or the session, and the output's kind."""

    frames: list[tuple[str, str]]
    callback: str | None
    callback_needed: bool
    session: str | None
    output: str | None
    others: list[str]
    any_names: bool

    @classmethod
    def read(cls, fn: Callable) -> Signature:
        try:
            hints = typing.get_type_hints(fn)
        except Exception:  # annotations that name what only type checkers see
            hints = {}
        sig = inspect.signature(fn)
        out = cls([], None, False, None, None, [], False)
        for p in sig.parameters.values():
            kind = kind_of(hints.get(p.name, p.annotation))
            if p.kind == p.VAR_KEYWORD:
                out.any_names = True
            elif kind in ("callback", "optional_callback") and out.callback is None:
                out.callback, out.callback_needed = p.name, kind == "callback" and p.default is p.empty
            elif kind == "session":
                out.session = p.name
            elif kind and kind not in ("none", "dict") and not out.others:
                out.frames.append((p.name, kind))
            else:
                out.others.append(p.name)
        returned = hints.get("return", sig.return_annotation)
        out.output = "none" if returned is None or "return" in getattr(fn, "__annotations__", {}) and fn.__annotations__["return"] is None else kind_of(returned)
        return out

    def check_params(self, params: dict[str, Any], fn: Callable) -> None:
        extra = set(params) - set(self.others)
        if extra and not self.any_names:
            raise ValidationError(f"{getattr(fn, '__name__', fn)} takes no {sorted(extra)}")
