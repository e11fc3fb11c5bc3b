"""What both vector searches share: which vectors take part, groups that queries stream past, and the exact merge of
partial top lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vector: Column, zero: bool) -> Column:
    """Not null nor empty, all components finite; with zero=False one component at least is not 0."""
    x = vector.cast("array<double>")
    fine = F.size(x) > 0
    fine = fine & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce(fine if zero else fine & F.exists(x, lambda v: v != 0), F.lit(False))


def taking_part(vectors: DataFrame, id_col: str, vector_col: str, zero: bool) -> tuple[DataFrame, int, int]:
    """(vec_id, v), their number and dimension. Ids must not be null; vectors of another size than the most usual (of
    equally usual ones the smallest) take no part."""
    kept = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("v"))
    kept = kept.where(F.col("vec_id").isNotNull() & usable(F.col("v"), zero))
    found = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d, n = (found["d"], found["count"]) if found else (0, 0)
    return kept.where(F.size("v") == d), n, d


def matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """The rows of a list column as doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks)
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def streamed(index: DataFrame, queries: DataFrame, groups: int, build: Callable[[pa.Table], Any], search: Callable[[Any, pa.RecordBatch], pa.RecordBatch], step: int, kinds: str) -> DataFrame:
    """What search finds for the queries of each group g in the group's index; both sides have (g, id, v, more).

    A task holds the index of one group, built once, while the group's queries stream past it, step at a time: nothing
    of the index is copied for further queries, and a group needs memory for its index alone.
    """
    sides = [df.select("g", F.lit(kind).alias("kind"), "id", "v", F.col("more").cast("binary").alias("more")) for kind, df in enumerate((index, queries))]
    dealt = sides[0].union(sides[1]).repartitionById(groups, F.col("g")).sortWithinPartitions("g", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, built = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column("g").to_numpy() * 2 + b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                g, kind = divmod(int(at[lo]), 2)
                if g != now:
                    now, held, built = g, [], None
                if not kind:
                    held.append(b.slice(lo, hi - lo))
                    continue
                if held:
                    built, held = build(pa.Table.from_batches(held)), []
                for first in range(lo, hi if built is not None else lo, step):
                    yield search(built, b.slice(first, min(step, hi - first)))

    return dealt.mapInArrow(run, kinds)


def smallest(values: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest finite values, ties to the smaller id."""
    if len(values) > n:
        bound = np.partition(values, n - 1)[n - 1]
        places = np.flatnonzero(values <= bound)
    else:
        places = np.arange(len(values))
    places = places[np.isfinite(values[places])]
    return places[np.lexsort((ids[places], values[places]))[:n]]


def best(hits: DataFrame, k: int, ascending: bool) -> DataFrame:
    """The first k hits of each query, ties to the smaller vec_id, with their rank from 1."""
    order = [F.col("score").asc() if ascending else F.col("score").desc(), F.col("vec_id").asc()]
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
