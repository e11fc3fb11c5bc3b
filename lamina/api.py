"""The functional API."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .functions import expressions as f  # noqa: F401
from .functions.expressions import agg_function, all_cols, col, function, lit, null

from .operators.extensions import CoTransformer, Creator, OutputCoTransformer, Outputter, OutputTransformer, Processor, Transformer  # noqa: F401
from .operators.extensions import cotransformer, creator, module, output_cotransformer, output_transformer, outputter, processor  # noqa: F401
from .operators.extensions import register, register_creator, register_module, register_output_transformer, register_outputter, register_parser, register_processor, register_transformer, transformer  # noqa: F401
from .operators.frames import EmptyAwareIterable, Frames  # noqa: F401
from .operators.joins import anti_join, broadcast, cross_join, full_outer_join, inner_join, intersect, join, left_outer_join, right_outer_join, semi_join, set_op, subtract, union
from .operators.output import as_array, as_array_iterable, as_dict_iterable, as_dicts, assert_eq, assert_not_eq, frame, head, peek_array, peek_dict, show, to_html
from .operators.partition import PartitionSpec, current_parallelism, partition_spec, persist, repartition
from .operators.relational import aggregate, alter_columns, assign, distinct, drop_columns, dropna, fillna, filter, normalize_column_names, rename, sample, select, select_columns, take  # noqa: A004
from .operators.udf import PartitionCursor, cotransform, out_cotransform, out_transform, transform, zip_frames  # noqa: F401
from .plans.flow import DEFAULTS, GLOBAL, Flow, register_global_conf  # noqa: F401
from .plans.sql import load_ipython_extension, raw_sql, xsql, xsql_flow  # noqa: F401
from .schema import format_schema, parse_schema, transform_schema
from .sources.io import load, load_table, save, save_and_use, save_table, table_exists
from .streaming.windows import sessions, windowed  # noqa: F401

_sessions: list[SparkSession] = []
_global: list[SparkSession] = []


def is_df(value: Any) -> bool:
    return isinstance(value, DataFrame)


def get_schema(df: DataFrame) -> str:
    return format_schema(df.schema)


def get_column_names(df: DataFrame) -> list[str]:
    return list(df.columns)


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def is_local(df: Any) -> bool:
    return not isinstance(df, DataFrame)


def is_bounded(df: Any) -> bool:
    return not (isinstance(df, DataFrame) and df.isStreaming)


def count(df: DataFrame) -> int:
    return df.count()


def get_num_partitions(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def as_pandas(df: DataFrame, columns: list[str] | None = None) -> Any:
    return (select_columns(df, columns) if columns else df).toPandas()


def as_arrow(df: DataFrame, columns: list[str] | None = None) -> Any:
    return (select_columns(df, columns) if columns else df).toArrow()


def as_local(df: DataFrame) -> Any:
    """The rows on the driver as one Arrow table."""
    return df.toArrow()


def as_local_bounded(df: DataFrame) -> Any:
    """as_local, of a frame that has an end."""
    if df.isStreaming:
        raise ValueError("a stream has no end")
    return df.toArrow()


def get_native_as_df(df: DataFrame) -> DataFrame:
    return df


def to_df(data: Any, schema: Any = None) -> DataFrame:
    return frame(get_session(), data, schema)


@contextlib.contextmanager
def session_context(spark: SparkSession | None = None) -> Iterator[SparkSession]:
    """The session that calls inside use when they are given none."""
    _sessions.append(spark or get_session())
    try:
        yield _sessions[-1]
    finally:
        _sessions.pop()


def set_global_session(spark: SparkSession) -> SparkSession:
    _global[:] = [spark]
    return spark


def clear_global_session() -> None:
    _global.clear()


def get_session() -> SparkSession:
    return (_sessions or _global or [SparkSession.builder.getOrCreate()])[-1]


def get_current_conf() -> dict[str, Any]:
    """The settings that a pipeline without its own would run with."""
    return DEFAULTS | GLOBAL


def get_current_parallelism() -> int:
    return current_parallelism(get_session())


def run_session_function(fn: Callable[[SparkSession], Any], spark: SparkSession | None = None) -> Any:
    with session_context(spark) as s:
        return fn(s)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "contextlib", "Any", "Callable", "Iterator")]
