"""Projection, filter, aggregation, null handling, sampling and top-k over one DataFrame; all of it plain Catalyst."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..functions.expressions import Expr, lit, to_expr
from ..schema import parse_schema


def ref(name: str) -> Column:
    """A column by its whole name."""
    return F.col("`" + name.replace("`", "``") + "`")


def need(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise SchemaError(f"no columns {missing} in {df.columns}")


def _outputs(exprs: list[Expr], df: DataFrame) -> list[str]:
    """The names that a projection gives, checked."""
    if sum(e.star for e in exprs) > 1:
        raise ValueError("one wildcard at most")
    names = [n for e in exprs for n in (df.columns if e.star else [e.name])]
    if "" in names:
        raise ValueError("every expression needs a name")
    if len(set(names)) < len(names):
        raise ValueError(f"doubled output names in {names}")
    return names


def select(df: DataFrame, *columns: Any, where: Any = None, having: Any = None, distinct: bool = False) -> DataFrame:
    """SELECT: texts name columns; what neither aggregates nor is a literal is a grouping key beside aggregates."""
    exprs = [to_expr(c) for c in columns]
    if not exprs:
        raise ValueError("nothing to select")
    aggregates = any(e.agg for e in exprs)
    if aggregates and any(e.star for e in exprs):
        raise ValueError("the wildcard cannot stand beside aggregates")
    names = _outputs(exprs, df)
    if where is not None:
        df = filter(df, where)
    if aggregates:
        keys = [e for e in exprs if not e.agg and not e.literal]
        aggs = [e.named() for e in exprs if e.agg]
        test = None if having is None else to_expr(having)
        if test is not None and test.agg:
            aggs.append(test.column().alias("__having"))
        out = (df.groupBy(*[k.named() for k in keys]) if keys else df).agg(*aggs)
        if test is not None:
            out = out.where(ref("__having") if test.agg else test.column())
        out = out.select(*[e.named() if e.literal else ref(n) for e, n in zip(exprs, names, strict=True)])
    elif having is not None:
        raise ValueError("HAVING needs aggregates")
    else:
        out = df.select(*[F.col("*") if e.star else e.named() for e in exprs])
    return out.distinct() if distinct else out


def filter(df: DataFrame, condition: Any) -> DataFrame:  # noqa: A001
    """The rows for which the condition is true; a null is not."""
    e = to_expr(condition)
    if e.agg or e.star:
        raise ValueError("a filter takes neither aggregates nor the wildcard")
    return df.where(e.column())


def assign(df: DataFrame, *exprs: Expr, **columns: Any) -> DataFrame:
    """Replaces columns in place and appends new ones, in order; every expression sees the old columns."""
    every = [*exprs, *((v if isinstance(v, Expr) else to_expr(v) if isinstance(v, Column) else lit(v)).alias(k) for k, v in columns.items())]
    if any(e.star or e.agg for e in every):
        raise ValueError("an assignment takes neither aggregates nor the wildcard")
    _outputs(every, df)
    new = {e.name: e.named() for e in every}
    return df.select(*[new.pop(c) if c in new else ref(c) for c in df.columns], *new.values())


def aggregate(df: DataFrame, partition_by: Any = None, *exprs: Expr, **aggs: Expr) -> DataFrame:
    """Aggregates of all rows or of each group of partition_by; nulls are a group. Keys come first."""
    keys = [partition_by] if isinstance(partition_by, str) else list(getattr(partition_by, "by", partition_by) or [])
    every = [*exprs, *(to_expr(v).alias(k) for k, v in aggs.items())]
    if not every or not all(e.agg for e in every):
        raise ValueError("aggregates, and nothing else, are needed")
    need(df, keys)
    _outputs([*map(to_expr, keys), *every], df)
    return (df.groupBy(*map(ref, keys)) if keys else df).agg(*[e.named() for e in every])


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """A missing column is an error."""
    need(df, list(names))
    out = [names.get(c, c) for c in df.columns]
    if len(set(out)) < len(out):
        raise SchemaError(f"doubled columns in {out}")
    return df.select(*[ref(c).alias(n) for c, n in zip(df.columns, out, strict=True)]) if names else df


def cast_column(c: Column, old: T.DataType, new: T.DataType) -> Column:
    """A cast that takes NaN for null where the new type has none, and text of any case for a truth value."""
    if old == new:
        return c
    if isinstance(old, (T.FloatType, T.DoubleType)) and not isinstance(new, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c)
    if isinstance(old, T.BooleanType) and isinstance(new, T.StringType):
        return c.cast(new)
    if isinstance(old, T.StringType) and isinstance(new, (T.ArrayType, T.StructType, T.MapType)):
        return F.from_json(c, new)
    if isinstance(old, (T.TimestampType, T.TimestampNTZType)) and isinstance(new, T.StringType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast(new)


def alter_columns(df: DataFrame, columns: Any) -> DataFrame:
    """Casts some columns, in place; a value that cannot be cast is an error."""
    change = {f.name: f.dataType for f in parse_schema(columns).fields}
    need(df, list(change))
    old = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[cast_column(ref(c), old[c], change[c]).alias(c) if c in change else ref(c) for c in df.columns])


def enforce(df: DataFrame, schema: Any) -> DataFrame:
    """The columns of a schema, in its order and types."""
    want = parse_schema(schema)
    need(df, want.names)
    old = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[cast_column(ref(f.name), old[f.name], f.dataType).alias(f.name) for f in want.fields])


def drop_columns(df: DataFrame, columns: list[str], if_exists: bool = False) -> DataFrame:
    if not if_exists:
        need(df, columns)
    left = [c for c in df.columns if c not in set(columns)]
    if not left:
        raise SchemaError("no column would be left")
    return df.select(*map(ref, left))


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if not columns:
        raise SchemaError("no columns")
    need(df, columns)
    return df.select(*map(ref, columns))


def normalize_column_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with names that are identifiers, and what renames them back."""
    taken, new = set(df.columns), {}
    for c in df.columns:
        if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", c):
            continue
        base = re.sub(r"\W", "_", c, flags=re.ASCII) or "_"
        base = name = f"_{base}" if base[0].isdigit() or not base.strip("_") else base
        n = 0
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        new[c] = name
    return rename(df, new), {v: k for k, v in new.items()}


def dropna(df: DataFrame, how: str = "any", thresh: int | None = None, subset: list[str] | None = None) -> DataFrame:
    """Drops rows with any or all nulls (NaN counts), or with fewer than thresh values."""
    if how not in ("any", "all"):
        raise ValueError(f"how is any or all, not {how!r}")
    if subset is not None:
        need(df, subset)
    names = subset or df.columns
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    there = [(ref(c).isNotNull() & ~F.isnan(ref(c))) if c in floats else ref(c).isNotNull() for c in names]
    at_least = thresh if thresh is not None else len(names) if how == "any" else 1
    count = lit(0).column()
    for t in there:
        count = count + t.cast("int")
    return df.where(count >= at_least)


def fillna(df: DataFrame, value: Any, subset: list[str] | None = None) -> DataFrame:
    """Fills nulls and NaN with one value, in all columns that take it or a subset, or with a value for each column."""
    if value is None or isinstance(value, (list, tuple)) or isinstance(value, dict) and (not value or any(v is None for v in value.values())):
        raise ValueError("a value, or a dict of values, that are not None is needed")
    if isinstance(value, dict):
        need(df, list(value))
        return df.na.fill(value)
    if subset is not None:
        need(df, subset)
    return df.na.fill(value, subset=subset)


def sample(df: DataFrame, n: int | None = None, frac: float | None = None, replace: bool = False, seed: int | None = None) -> DataFrame:
    """About a share frac of the rows, or exactly n rows (fewer if there are fewer and replace is off).

    A sample of n is a top-n by a random key, which every task cuts before the exchange. With replacement, n draws of
    row places are grouped and joined with the numbered rows.
    """
    if (n is None) == (frac is None):
        raise ValueError("either n or frac is needed")
    if frac is not None:
        if frac < 0 or frac > 1 and not replace:
            raise ValueError("frac lies between 0 and 1")
        return df.sample(withReplacement=replace, fraction=float(frac), seed=seed)
    if n < 0:
        raise ValueError("n must not be negative")
    if not replace:
        return df.withColumn("__key", F.rand(seed)).orderBy("__key").limit(n).drop("__key")
    from .partition import numbered, steady

    fixed = steady(df)
    total = fixed.count()
    if not total:
        return df.limit(0)
    draws = df.sparkSession.range(n).select(F.floor(F.rand(seed) * total).cast("long").alias("__at"))
    return draws.join(numbered(fixed), "__at").drop("__at")


def parse_presort(presort: Any) -> dict[str, bool]:
    """An order "a, b desc" or names or (name, ascending) pairs to {name: ascending}."""
    if not presort:
        return {}
    if isinstance(presort, dict):
        return dict(presort)
    out: dict[str, bool] = {}
    for part in presort.split(",") if isinstance(presort, str) else presort:
        if isinstance(part, str):
            m = re.fullmatch(r"\s*(`(?:[^`]|``)+`|\S+)(?:\s+(asc|desc))?\s*", part, re.I)
            if not m:
                raise SyntaxError(f"{part!r} is no order")
            name, up = m[1], (m[2] or "asc").lower() == "asc"
            name = name[1:-1].replace("``", "`") if name.startswith("`") else name
        else:
            name, up = part
        if name in out:
            raise SyntaxError(f"{name} twice in the order")
        out[name] = bool(up)
    return out


def ordering(presort: dict[str, bool], na_position: str = "last", df: DataFrame | None = None) -> list[Column]:
    """Nulls, and NaN with them, go first or last whatever the direction. df: the frame, by which columns that hold no NaN
    are told."""
    if na_position not in ("first", "last"):
        raise ValueError("na_position is first or last")
    way = {(True, "first"): "asc_nulls_first", (True, "last"): "asc_nulls_last", (False, "first"): "desc_nulls_first", (False, "last"): "desc_nulls_last"}
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))} if df is not None else set()
    return [getattr(F.nanvl(ref(c), F.lit(None)) if c in floats else ref(c), way[up, na_position])() for c, up in presort.items()]


def take(df: DataFrame, n: int, presort: Any = "", na_position: str = "last", partition: Any = None) -> DataFrame:
    """The first n rows, of all or of each group of partition, in an order; without one any n rows."""
    if not isinstance(n, int) or isinstance(n, bool):
        raise ValueError("n must be an integer")
    keys = [partition] if isinstance(partition, str) else list(getattr(partition, "by", partition) or [])
    order = parse_presort(presort) or parse_presort(getattr(partition, "presort", None))
    need(df, [*keys, *order])
    by = ordering(order, na_position, df)
    if not keys:
        return (df.orderBy(*by) if by else df).limit(n)
    if n == 1 and not by:
        return df.dropDuplicates(keys)
    rank = F.row_number().over(W.partitionBy(*map(ref, keys)).orderBy(*(by or [F.lit(0)])))
    return df.withColumn("__rank", rank).where(ref("__rank") <= n).drop("__rank")
