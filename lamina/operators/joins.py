"""Joins by common column names, set operations and the broadcast hint."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..schema import format_schema, same_schema
from .relational import ref

_HOW = {
    "inner": "inner", "cross": "cross", "leftsemi": "left_semi", "semi": "left_semi", "leftanti": "left_anti", "anti": "left_anti",
    "leftouter": "left_outer", "left": "left_outer", "rightouter": "right_outer", "right": "right_outer",
    "fullouter": "full_outer", "full": "full_outer",
}


def join_kind(how: str) -> str:
    kind = _HOW.get(how.lower().replace("_", "").replace(" ", ""))
    if kind is None:
        raise ValueError(f"unknown join {how!r}")
    return kind


def join_keys(left: list[str], right: list[str], kind: str, on: list[str] | None) -> list[str]:
    """The keys in the left side's order: all common names, which on may only repeat; semi and anti joins look at on alone."""
    on = list(on or [])
    if len(set(on)) < len(on):
        raise SchemaError(f"doubled keys in {on}")
    common = [c for c in left if c in set(right)]
    if kind == "cross":
        if on or common:
            raise SchemaError("a cross join has no keys and no common columns")
        return []
    if on and kind in ("left_semi", "left_anti"):
        missing = [c for c in on if c not in common]
        if missing:
            raise SchemaError(f"keys {missing} are not on both sides")
        return [c for c in common if c in set(on)]
    if not common:
        raise SchemaError("no common columns")
    if on and set(on) != set(common):
        raise SchemaError(f"keys {on} differ from the common columns {common}")
    return common


def _join(left: DataFrame, right: DataFrame, kind: str, on: list[str] | None) -> DataFrame:
    keys = join_keys(left.columns, right.columns, kind, on)
    if kind == "cross":
        return left.crossJoin(right)
    if kind in ("left_semi", "left_anti"):
        return left.join(right.select(*map(ref, keys)), keys, kind)
    out = left.join(right, keys, kind)
    return out.select(*[ref(c) for c in [*left.columns, *(c for c in right.columns if c not in set(keys))]])


def join(df1: DataFrame, df2: DataFrame, *dfs: DataFrame, how: str, on: list[str] | None = None) -> DataFrame:
    """From left to right. Null keys meet nothing; columns are the left ones, then the right ones that are no keys."""
    kind = join_kind(how)
    return reduce(lambda a, b: _join(a, b, kind, on), (df2, *dfs), df1)


def inner_join(df1: DataFrame, df2: DataFrame, *dfs: DataFrame, on: list[str] | None = None) -> DataFrame:
    return join(df1, df2, *dfs, how="inner", on=on)


def semi_join(df1: DataFrame, df2: DataFrame, *dfs: DataFrame, on: list[str] | None = None) -> DataFrame:
    return join(df1, df2, *dfs, how="semi", on=on)


def anti_join(df1: DataFrame, df2: DataFrame, *dfs: DataFrame, on: list[str] | None = None) -> DataFrame:
    return join(df1, df2, *dfs, how="anti", on=on)


def left_outer_join(df1: DataFrame, df2: DataFrame, *dfs: DataFrame, on: list[str] | None = None) -> DataFrame:
    return join(df1, df2, *dfs, how="left_outer", on=on)


def right_outer_join(df1: DataFrame, df2: DataFrame, *dfs: DataFrame, on: list[str] | None = None) -> DataFrame:
    return join(df1, df2, *dfs, how="right_outer", on=on)


def full_outer_join(df1: DataFrame, df2: DataFrame, *dfs: DataFrame, on: list[str] | None = None) -> DataFrame:
    return join(df1, df2, *dfs, how="full_outer", on=on)


def cross_join(df1: DataFrame, df2: DataFrame, *dfs: DataFrame) -> DataFrame:
    return join(df1, df2, *dfs, how="cross")


left_semi_join, left_anti_join = semi_join, anti_join


def broadcast(df: DataFrame) -> DataFrame:
    """The caller's word that a frame is small. Without the hint Spark decides by measured size."""
    return F.broadcast(df)


def set_op(how: str, df1: DataFrame, df2: DataFrame, *dfs: DataFrame, distinct: bool = True) -> DataFrame:
    """union, subtract or intersect by position, from left to right; schemas must be equal, and null equals null."""
    apply: dict[tuple[str, bool], Any] = {
        ("union", True): lambda a, b: a.union(b),
        ("union", False): lambda a, b: a.union(b),
        ("subtract", True): lambda a, b: a.subtract(b),
        ("subtract", False): lambda a, b: a.exceptAll(b),
        ("intersect", True): lambda a, b: a.intersect(b),
        ("intersect", False): lambda a, b: a.intersectAll(b),
    }
    if (how, distinct) not in apply:
        raise ValueError(f"unknown set operation {how!r}")
    for other in (df2, *dfs):
        if not same_schema(df1.schema, other.schema):
            raise SchemaError(f"{format_schema(df1.schema)} differs from {format_schema(other.schema)}")
    out = reduce(apply[how, distinct], (df2, *dfs), df1)
    return out.distinct() if how == "union" and distinct else out


def union(df1: DataFrame, df2: DataFrame, *dfs: DataFrame, distinct: bool = True) -> DataFrame:
    return set_op("union", df1, df2, *dfs, distinct=distinct)


def subtract(df1: DataFrame, df2: DataFrame, *dfs: DataFrame, distinct: bool = True) -> DataFrame:
    return set_op("subtract", df1, df2, *dfs, distinct=distinct)


def intersect(df1: DataFrame, df2: DataFrame, *dfs: DataFrame, distinct: bool = True) -> DataFrame:
    return set_op("intersect", df1, df2, *dfs, distinct=distinct)


