"""The column algebra: named expressions that know their output name and whether they aggregate."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import parse_type

#: Built-in aggregates that function() recognises by name.
AGGREGATES = {
    "any_value", "approx_count_distinct", "approx_percentile", "array_agg", "avg", "bit_and", "bit_or", "bit_xor", "bool_and", "bool_or",
    "collect_list", "collect_set", "corr", "count", "count_if", "covar_pop", "covar_samp", "every", "first", "first_value", "kurtosis", "last",
    "last_value", "listagg", "max", "max_by", "mean", "median", "min", "min_by", "mode", "percentile", "percentile_approx", "skewness", "some",
    "std", "stddev", "stddev_pop", "stddev_samp", "string_agg", "sum", "try_avg", "try_sum", "var_pop", "var_samp", "variance",
}


class Expr:
    """An expression over the columns of one frame.

    column() gives Spark's Column without name; name is the output's, "" if it must be given; agg tells aggregates,
    literal constants and star the wildcard.
    """

    def __init__(self, build: Callable[[], Column], *, name: str = "", given: str = "", agg: bool = False, literal: bool = False, star: bool = False, columns: frozenset[str] = frozenset(), text: str = ""):
        self._build, self.inferred, self.given = build, name, given
        self.agg, self.literal, self.star, self.columns, self.text = agg, literal, star, columns, text

    @property
    def name(self) -> str:
        return self.given or self.inferred

    def column(self) -> Column:
        return self._build()

    def named(self) -> Column:
        return self.column().alias(self.name)

    def _with(self, **changes: Any) -> Expr:
        kept = {"name": self.inferred, "given": self.given, "agg": self.agg, "literal": self.literal, "star": self.star, "columns": self.columns, "text": self.text}
        return Expr(changes.pop("build", self._build), **(kept | changes))

    def alias(self, name: str) -> Expr:
        if self.star:
            raise ValueError("the wildcard has no alias")
        return self._with(given=name)

    def infer_alias(self) -> Expr:
        """The same, with the name it has by its argument, if any."""
        return self._with(given=self.name)

    def cast(self, kind: Any) -> Expr:
        to = parse_type(kind)
        return self._with(build=lambda: self.column().cast(to), text=f"CAST({self.text} AS {to.simpleString()})")

    def infer_type(self, schema: T.StructType) -> T.DataType | None:
        """The type of a plain column of a schema; None where only analysis can tell."""
        return next((f.dataType for f in schema.fields if {f.name} == self.columns and self.text in (f.name, _quoted(f.name))), None)

    def is_null(self) -> Expr:
        return self._with(build=lambda: self.column().isNull(), name="", given="", text=f"({self.text} IS NULL)")

    def not_null(self) -> Expr:
        return self._with(build=lambda: self.column().isNotNull(), name="", given="", text=f"({self.text} IS NOT NULL)")

    def __neg__(self) -> Expr:
        return self._with(build=lambda: -self.column(), given="", text=f"(-{self.text})")

    def __pos__(self) -> Expr:
        return self

    def __invert__(self) -> Expr:
        return self._with(build=lambda: ~self.column(), given="", text=f"(NOT {self.text})")

    __hash__ = object.__hash__

    def __bool__(self) -> bool:
        raise ValueError("an expression has no truth value; combine with &, | and ~")

    def __repr__(self) -> str:
        return self.text + (f" AS {self.given}" if self.given else "")

    uuid = property(__repr__)

    def sql(self) -> str:
        """The expression as Spark SQL, without its alias."""
        return self.text


def _binary(sign: str, apply: Callable[[Column, Column], Column], swapped: bool = False):
    def method(self: Expr, other: Any) -> Expr:
        a, b = self, to_expr(other, text_is_column=False)
        if swapped:
            a, b = b, a
        if a.star or b.star:
            raise ValueError("the wildcard is no operand")
        return Expr(lambda: apply(a.column(), b.column()), agg=a.agg or b.agg, literal=a.literal and b.literal, columns=a.columns | b.columns, text=f"({a.text} {sign} {b.text})")

    return method


for _name, _sign, _apply in (
    ("add", "+", lambda a, b: a + b), ("sub", "-", lambda a, b: a - b), ("mul", "*", lambda a, b: a * b), ("truediv", "/", lambda a, b: a / b),
    ("and", "AND", lambda a, b: a & b), ("or", "OR", lambda a, b: a | b),
):
    setattr(Expr, f"__{_name}__", _binary(_sign, _apply))
    setattr(Expr, f"__r{_name}__", _binary(_sign, _apply, swapped=True))
for _name, _sign, _apply in (
    ("lt", "<", lambda a, b: a < b), ("le", "<=", lambda a, b: a <= b), ("gt", ">", lambda a, b: a > b), ("ge", ">=", lambda a, b: a >= b),
    ("eq", "=", lambda a, b: a == b), ("ne", "<>", lambda a, b: a != b),
):
    setattr(Expr, f"__{_name}__", _binary(_sign, _apply))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def all_cols() -> Expr:
    return Expr(lambda: F.col("*"), star=True, text="*")


def col(name: str | Expr, alias: str = "") -> Expr:
    """A column by its whole name, dots and blanks included; "*" is the wildcard."""
    if isinstance(name, Expr):
        return name.alias(alias) if alias else name
    if name == "*":
        return all_cols()
    return Expr(lambda: F.col(_quoted(name)), name=name, given=alias, columns=frozenset([name]), text=name if re.fullmatch(r"[A-Za-z_]\w*", name) else _quoted(name))


def lit(value: Any, alias: str = "") -> Expr:
    if value is not None and not isinstance(value, (bool, int, float, str)):
        raise NotImplementedError(f"{type(value).__name__} is no literal")
    text = "NULL" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value).upper() if isinstance(value, bool) else str(value)
    return Expr(lambda: F.lit(value), given=alias, literal=True, text=text)


def null() -> Expr:
    return lit(None)


def to_expr(value: Any, text_is_column: bool = True) -> Expr:
    """Texts are column names or literals, as told; Spark Columns pass through."""
    if isinstance(value, Expr):
        return value
    if isinstance(value, Column):
        return Expr(lambda: value, text=str(value))
    if isinstance(value, str) and text_is_column:
        return col(value)
    return lit(value)


def _call(name: str, args: tuple, agg: bool, distinct: bool, inferred: str = "", options: dict[str, Any] | None = None) -> Expr:
    parts = [to_expr(a, text_is_column=False) for a in args]
    named = {k: to_expr(v, text_is_column=False) for k, v in (options or {}).items()}
    if any(p.agg for p in parts) and agg:
        raise ValueError(f"{name} over an aggregate")
    every = [*parts, *named.values()]

    def build() -> Column:
        if distinct or named:
            # Placeholders carry the arguments through Spark's own parser, which knows DISTINCT and named arguments.
            given = [p.text for p in parts]
            if distinct and name.lower() == "count" and not named:
                return F.count_distinct(*[p.column() for p in parts])
            words = ", ".join([*given, *(f"{k} => {v.text}" for k, v in named.items())])
            return F.expr(f"{name}({'DISTINCT ' if distinct else ''}{words})")
        if len(parts) == 1 and parts[0].star and name.lower() == "count":
            return F.count(F.lit(1))
        return F.call_function(name, *[p.column() for p in parts])

    text = f"{name.upper()}({'DISTINCT ' if distinct else ''}{', '.join([*(p.text for p in parts), *(f'{k} => {v.text}' for k, v in named.items())])})"
    return Expr(build, name=inferred, agg=agg or any(p.agg for p in every), columns=frozenset().union(*(p.columns for p in every)), text=text)


def function(name: str, *args: Any, arg_distinct: bool = False, **options: Any) -> Expr:
    """Any built-in function by name; texts are literals, col() names columns. Known aggregates aggregate."""
    return _call(name, args, name.lower() in AGGREGATES, arg_distinct, options=options)


def agg_function(name: str, *args: Any, arg_distinct: bool = False, **options: Any) -> Expr:
    """Any function by name, as an aggregate."""
    return _call(name, args, True, arg_distinct, options=options)


def coalesce(*args: Any) -> Expr:
    return _call("coalesce", args, False, False)


def _aggregate(name: str):
    def make(column: Any) -> Expr:
        e = to_expr(column)
        return _call(name, (e,), True, False, "" if e.star else e.name)

    make.__name__ = name
    make.__doc__ = f"{name.upper()} of a column, named like it."
    return make


min, max, sum, avg, count, first, last = (_aggregate(n) for n in ("min", "max", "sum", "avg", "count", "first", "last"))  # noqa: A001
mean = avg


def count_distinct(column: Any) -> Expr:
    """COUNT(DISTINCT column); of the wildcard: of rows without nulls."""
    e = to_expr(column)
    if e.star:
        return Expr(lambda: F.count_distinct(F.col("*")), agg=True, text="COUNT(DISTINCT *)")
    return _call("count", (e,), True, True, e.name)


def is_agg(value: Any) -> bool:
    return isinstance(value, Expr) and value.agg
