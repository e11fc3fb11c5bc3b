"""Streams: the stateless operators work on them as they are; this adds windowed aggregation with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Expr
from ..operators.relational import need, ref


def windowed(df: DataFrame, time: str, length: str, slide: str | None = None, *, late: str = "0 seconds", by: list[str] | None = None, **aggs: Expr) -> DataFrame:
    """Aggregates of each window of event time (and key): window_start, window_end, keys, aggregates.

    Works on streams and on bounded frames alike; on a stream, rows later than `late` behind the newest are dropped and a
    window is complete, and its state gone, once that time has passed.
    """
    keys = list(by or [])
    need(df, [time, *keys])
    if not aggs or not all(e.agg for e in aggs.values()):
        raise ValueError("aggregates, and nothing else, are needed")
    rows = df.withWatermark(time, late) if df.isStreaming else df
    window = F.window(ref(time), length, slide) if slide else F.window(ref(time), length)
    out = rows.groupBy(window.alias("__window"), *map(ref, keys)).agg(*[e.alias(n).named() for n, e in aggs.items()])
    return out.select(F.col("__window.start").alias("window_start"), F.col("__window.end").alias("window_end"), *map(ref, keys), *map(ref, aggs))


def sessions(df: DataFrame, time: str, gap: str, *, late: str = "0 seconds", by: list[str] | None = None, **aggs: Expr) -> DataFrame:
    """The same over sessions: runs of rows of a key with pauses shorter than gap."""
    keys = list(by or [])
    need(df, [time, *keys])
    rows = df.withWatermark(time, late) if df.isStreaming else df
    out = rows.groupBy(F.session_window(ref(time), gap).alias("__window"), *map(ref, keys)).agg(*[e.alias(n).named() for n, e in aggs.items()])
    return out.select(F.col("__window.start").alias("window_start"), F.col("__window.end").alias("window_end"), *map(ref, keys), *map(ref, aggs))
