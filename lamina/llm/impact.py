"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components are shifted to non-negative integers, whose digits of DIGIT bits are the quantised impacts: the posting
segment of a dimension and a digit at a place holds the vectors with that digit there. As each vector has a digit in
each dimension, the segments of one place are kept together as one plane of digits. Planes are processed by descending
impact. After each, every score is known up to the weight of the digits that follow, so a vector whose score cannot
reach the k-th best one, nor the k-th best of a sample of all vectors, is proven out, and its postings are skipped from
then on. When few possible members are left, or no plane, these are rescored exactly: the result is exact wherever the
processing stops.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import best, matrix, streamed, taking_part

#: Rows of an index group at most (about), the fewest groups, and queries that are processed together.
GROUP_ROWS, FEWEST_GROUPS, QUERY_STEP = 16_384, 24, 32
#: Bits of a digit, and possible members, as a multiple of k, at which rescoring beats a further plane.
DIGIT, RESCORE = 4, 16
#: Vectors (about) of the sample whose scores bound a query's k-th best from below.
SAMPLE = 2048

SCORES = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * float(scale)).cast("long"))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """The same on the rows of a matrix of doubles; components beyond 2^53 are refused."""
    out = np.floor(x * float(scale))
    if len(out) and np.abs(out).max() >= 1 << 53:
        raise ValueError(f"components must stay below 2^53 / {scale}")
    return out.astype(np.int64)


def check_range(x: np.ndarray, q: np.ndarray) -> None:
    """Scores must fit 64 bits."""
    if len(x) and len(q) and int(np.abs(x).max()) * int(np.abs(q).astype(object).sum(axis=1).max()) >= 1 << 63:
        raise ValueError("scores do not fit 64 bits")


class ImpactIndex:
    """Planes of a group's digits, from the highest."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.low = x.min(axis=0)
        shifted = x - self.low
        self.top = int(shifted.max()).bit_length()
        places = range(DIGIT * (max(self.top - 1, 0) // DIGIT), -1, -DIGIT)
        self.planes = [(at, ((shifted >> at) & ((1 << DIGIT) - 1)).astype(np.uint8)) for at in places]

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query ids, vector ids, scores) of each query's k best, and the planes that were not needed.

        floor: scores that each query's k-th best of all vectors is known to reach; lower ones are left out.
        """
        check_range(self.x, q)
        weight = np.abs(q).sum(axis=1).astype(object)
        exact = int(max(weight, default=0)) << max(self.top, 1) < 1 << 52  # partial scores stay exact in doubles
        more, less = np.maximum(q, 0).sum(axis=1).astype(np.float64), np.maximum(-q, 0).sum(axis=1).astype(np.float64)
        least = np.full(len(q), -np.inf) if floor is None or not exact else floor - (q * self.low).sum(axis=1).astype(np.float64)
        alive, seen = np.arange(len(self.x)), np.zeros((len(q), len(self.x)))
        possible, skipped = q_ids[:, None] != self.ids[None], 0
        for done, (at, plane) in enumerate(self.planes if exact else []):
            if not len(alive):
                skipped = len(self.planes) - done
                break
            seen += (q * float(1 << at)) @ plane[alive].T.astype(np.float64)
            rest = float((1 << at) - 1)
            if len(alive) > k:
                partial = np.where(possible, seen, -np.inf)
                kth = np.partition(partial, -k, axis=1)[:, -k]
                least = np.maximum(least, kth - less * rest)
            possible &= seen + (more * rest)[:, None] >= least[:, None]
            if possible.sum() <= RESCORE * k * len(q):
                skipped = len(self.planes) - done - 1
                break
            used = possible.any(axis=0)
            if used.mean() < 0.8:
                alive, seen, possible = alive[used], seen[:, used], possible[:, used]
        out: list[list[np.ndarray]] = [[], [], []]
        for i, row in enumerate(possible):
            at = alive[np.flatnonzero(row)]
            scores = self.x[at] @ q[i]
            order = np.lexsort((self.ids[at], -scores))[:k]
            out[0].append(np.full(len(order), q_ids[i]))
            out[1].append(self.ids[at][order])
            out[2].append(scores[order])
        return *(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out), skipped


def floors(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among a sample, or the least number if the sample holds fewer others."""
    out = np.full(len(q), np.iinfo(np.int64).min)
    if len(ids) >= k and len(q):
        check_range(x, q)
        scores = np.where(q_ids[:, None] == ids[None], out[0], q @ x.T)
        out = np.partition(scores, -k, axis=1)[:, -k]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all vectors but itself.

    The index is dealt out by the hash of vec_id and input partition into groups of about group_rows vectors, each with
    its own planes; queries stream past them. Each query starts from the k-th best score of a bounded sample, which all
    groups share. A group gives at most k hits of each query, which are merged.

    Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do null ids and
    vectors of an unusual size; zero vectors do; ties go to the smaller vec_id; equal rows are found each; fewer than k
    candidates give fewer rows; an empty table gives none; other columns are ignored. Scores that may not fit 64 bits
    raise a ValueError.
    """
    kept, n, d = taking_part(vectors, id_col, vector_col, zero=True)
    asked, _, _ = taking_part(queries, id_col, vector_col, zero=True)
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups = max(FEWEST_GROUPS, -(-n // group_rows))
    place = F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30))
    sample = kept.where(place <= int((1 << 30) * min(1.0, SAMPLE / n))).orderBy(place, "vec_id").limit(2 * SAMPLE).toArrow()
    s_ids = sample.column("vec_id").to_numpy()
    s_x = integers(matrix(sample.column("v"), d), scale) if sample.num_rows else np.zeros((0, d), np.int64)
    spread = F.pmod(F.xxhash64("vec_id", F.spark_partition_id()), F.lit(groups)).cast("int")
    index = kept.select(spread.alias("g"), F.col("vec_id").alias("id"), "v", F.lit(None).cast("binary").alias("more"))

    def bound(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                least = floors(b.column(0).to_numpy(), integers(matrix(b.column(1), d), scale), s_ids, s_x, k)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in least], pa.binary())], names=["id", "v", "more"])

    bounded = asked.mapInArrow(bound, f"id long, v {asked.schema['v'].dataType.simpleString()}, more binary")
    wanted = bounded.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "id", "v", "more")

    def build(t: pa.Table) -> ImpactIndex:
        return ImpactIndex(t.column("id").to_numpy(), integers(matrix(t.column("v"), d), scale))

    def search(group: ImpactIndex, b: pa.RecordBatch) -> pa.RecordBatch:
        least = np.frombuffer(b"".join(b.column("more").to_pylist()), np.int64)
        found = group.search(b.column("id").to_numpy(), integers(matrix(b.column("v"), d), scale), k, least)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found[:3]], schema=SCORES)

    return best(streamed(index, wanted, groups, build, search, QUERY_STEP, "query_id long, vec_id long, score long"), k, ascending=False)
