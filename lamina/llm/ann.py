"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and code books are fitted on a bounded sample; every vector is indexed. A query visits the lists of its
nearest centroids, ranks their codes by an asymmetric distance table and measures the best of them exactly. Distances to
the sample and to these bound how far the k-th nearest can lie: lists whose radius, and codes whose error, do not prove
that they are farther are searched too, so no near vector is lost, whatever the vectors' distribution.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import HITS, best, matrix, smallest, streamed, taking_part

#: Bounds of the fit: vectors of the sample (about), lists, code words of a subspace, and components of a subspace.
SAMPLE, MOST_LISTS, WORDS, SUBSPACE = 8192, 4096, 256, 4
#: Share of the lists that a query visits, and candidates of a group that are measured exactly; more where bounds ask for it.
PROBE_SHARE, RERANK = 0.7, 64
#: Vectors of a group at most (about) and at least, the fewest groups of larger tables, and queries of one step.
GROUP_ROWS, FEWEST_ROWS, FEWEST_GROUPS, QUERY_STEP = 32_768, 512, 24, 64
#: Components that are measured exactly at once.
MEASURED = 1 << 21


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; deterministic. Fewer centroids if x has fewer distinct rows."""
    x = np.asarray(x, np.float64)
    starts = np.unique(x, axis=0)
    c = starts[np.linspace(0, len(starts) - 1, min(k, len(starts))).astype(int)] if len(starts) else np.zeros((1, x.shape[1]))
    for _ in range(rounds):
        own = nearest(x, c)
        sums, sizes = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, max(len(x), 1), 4096)])


def slack(reach: np.ndarray, d: int) -> np.ndarray:
    """More than rounding changes a squared distance that is added up from products of vectors whose lengths add up to reach."""
    return 32 * np.finfo(np.float64).eps * (d + 16) * reach**2


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(axis=1))


@dataclass
class IvfPq:
    """Coarse centroids (lists, d) and code books (subspaces, words, components) of residuals, padded to full subspaces."""

    centroids: np.ndarray
    books: np.ndarray

    def parts(self, residuals: np.ndarray) -> np.ndarray:
        m, _, s = self.books.shape
        return np.pad(residuals, ((0, 0), (0, m * s - residuals.shape[1]))).reshape(len(residuals), m, s)

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector and the codes of its residual."""
        lists = nearest(x, self.centroids)
        parts = self.parts(x - self.centroids[lists])
        return lists, np.stack([nearest(parts[:, j], b) for j, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def residuals(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)[:, : self.centroids.shape[1]]

    def constants(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The part of each coded vector's distance that no query changes: |r|^2 + 2 c.r for centroid c and residual r."""
        r = self.residuals(codes)
        return (r**2).sum(axis=1) + 2 * (r * self.centroids[lists]).sum(axis=1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, subspaces, words): -2 q.w, one table for all lists."""
        return -2 * np.einsum("qms,mws->qmw", self.parts(queries), self.books)

    def distances(self, queries: np.ndarray, lists: int, codes: np.ndarray, constants: np.ndarray | None = None, tables: np.ndarray | None = None) -> np.ndarray:
        """Asymmetric: squared distances of exact queries to coded vectors of one list, by table."""
        tables = self.tables(queries) if tables is None else tables
        constants = self.constants(np.full(len(codes), lists), codes) if constants is None else constants
        out = ((queries - self.centroids[lists]) ** 2).sum(axis=1)[:, None] + constants[None]
        for j in range(tables.shape[1]):
            out += tables[:, j][:, codes[:, j]]
        return out


def fit_index(x: np.ndarray, n: int) -> IvfPq:
    """For n vectors, from a sample x of them."""
    c = kmeans(x, max(1, min(MOST_LISTS, int(math.sqrt(n)))))
    m = max(1, -(-x.shape[1] // SUBSPACE))
    model = IvfPq(c, np.zeros((m, 1, SUBSPACE)))
    parts = model.parts(x - c[nearest(x, c)])
    books = [kmeans(parts[:, j], WORDS, 5) for j in range(m)]
    widest = max(map(len, books))  # a repeated word codes nothing, as the first one wins
    model.books = np.stack([np.concatenate([b, np.repeat(b[:1], widest - len(b), axis=0)]) for b in books])
    return model


class Group:
    """The lists of one group: ids, vectors and codes, ordered by list and id."""

    def __init__(self, model: IvfPq, ids: np.ndarray, x: np.ndarray, lists: np.ndarray, codes: np.ndarray):
        order = np.lexsort((ids, lists))
        self.model, self.ids, self.x, self.codes = model, ids[order], x[order], codes[order]
        self.names, starts = np.unique(lists[order], return_index=True)
        self.slices = [slice(lo, hi) for lo, hi in zip(starts, [*starts[1:], len(ids)], strict=True)]
        self.constants = model.constants(lists[order], self.codes)
        self.sizes, self.errors, self.reach = lengths(self.x), np.zeros(len(ids)), np.zeros(len(ids))
        for name, at in zip(self.names, self.slices, strict=True):
            c, r = model.centroids[name], model.residuals(self.codes[at])
            self.errors[at] = lengths(self.x[at] - c - r)
            self.reach[at] = self.sizes[at] + lengths(r) + np.sqrt((c**2).sum())

    def exact(self, places: np.ndarray, q: np.ndarray) -> np.ndarray:
        step = max(1, MEASURED // len(q))
        return np.concatenate([lengths(self.x[places[i : i + step]] - q) for i in range(0, max(len(places), 1), step)])

    def unproven(self, guess: np.ndarray, q: np.ndarray, limits: np.ndarray, k: int) -> list[np.ndarray]:
        """Places of each query's visited vectors that may be of its k nearest, as these lie within its limit.

        A vector's distance is that of its code less the code's error at least. What this leaves is looked at whole, all
        queries' in one product, whose k-th distance may lower the limit.
        """
        sizes, d = lengths(q), q.shape[1]
        may = np.stack([np.isfinite(row) & (row - slack(size + self.reach, d) <= (limit + self.errors) ** 2) for row, size, limit in zip(guess, sizes, limits, strict=True)])
        rows = np.flatnonzero(may.any(axis=0))
        near = sizes[:, None] ** 2 + self.sizes[rows] ** 2 - 2 * q @ self.x[rows].T
        out = []
        for i, size in enumerate(sizes):
            at = np.flatnonzero(may[i, rows])
            off = slack(size + self.sizes[rows[at]], d)
            limit = min(limits[i] ** 2, np.partition(near[i, at] + off, k - 1)[k - 1]) if len(at) >= k else limits[i] ** 2
            out.append(rows[at[near[i, at] - off <= limit]])
        return out

    def search(self, q_ids: np.ndarray, q: np.ndarray, visits: list[np.ndarray], k: int, rerank: int, limits: np.ndarray | None = None) -> tuple[list, int]:
        """(query ids, vector ids, distances) of the k nearest of each query, and how many were measured exactly.

        Those are the rerank whose codes are nearest. With limits, no less than each query's distance to its k-th nearest,
        they are all whose codes do not prove that they are farther; what lies beyond the limit may then be missing.
        """
        guess, tables = np.full((len(q), len(self.ids)), np.inf), self.model.tables(q)
        for name, at in zip(self.names, self.slices, strict=True):
            asked = np.flatnonzero([name in v for v in visits])
            if len(asked):
                guess[asked, at] = self.model.distances(q[asked], name, self.codes[at], self.constants[at], tables[asked])
        guess[q_ids[:, None] == self.ids[None]] = np.inf
        out: list[list[np.ndarray]] = [[], [], []]
        measured = 0
        chosen = [smallest(row, self.ids, max(rerank, k)) for row in guess]
        if limits is not None:
            measured += sum(map(len, chosen))
            kth = [np.partition(self.exact(c, v), k - 1)[k - 1] if len(c) >= k else np.inf for c, v in zip(chosen, q, strict=True)]
            chosen = self.unproven(guess, q, np.minimum(limits, kth), k)
        for i, found in enumerate(chosen):
            exact = self.exact(found, q[i])
            order = np.lexsort((self.ids[found], exact))[:k]
            measured += len(found)
            for column, values in zip(out, (np.full(len(order), q_ids[i]), self.ids[found][order], exact[order]), strict=True):
                column.append(values)
        return out, measured


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", probe_share: float = PROBE_SHARE, rerank: int = RERANK, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query but itself, by Euclidean distance in doubles.

    Lists are put together to groups of about group_rows vectors, larger ones split by the hash of vec_id and input partition, so a task's
    group is bounded also where one list holds a third of all vectors. A query goes to the groups that hold lists it
    visits: probe_share of all, further ones, by nearness, until these hold k candidates, and every one whose radius does
    not prove that it is farther than the k nearest of the sample. In each group, table distances over all its visited
    lists choose rerank candidates, which are measured exactly, and so is every other that its code's error does not
    prove to be farther than these: the result is exact, and the parameters only change the work. Only the sample, the
    fitted centroids and code books, and the lists' sizes and radii, which all are bounded, go to all tasks.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null
    ids and vectors of an unusual size; ties go to the smaller vec_id; equal rows are found each; fewer than k
    candidates give fewer rows; an empty table gives none; other columns are ignored. Squared distances must fit a double.
    """
    spark = vectors.sparkSession
    kept, n, d = taking_part(vectors, id_col, vector_col, zero=False)
    asked, _, _ = taking_part(queries, id_col, vector_col, zero=False)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    place = F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30))
    sample = kept.where(place <= int((1 << 30) * min(1.0, SAMPLE / n))).orderBy(place, "vec_id").limit(2 * SAMPLE).select("vec_id", "v").toArrow()
    sample_ids, sample_x = sample.column("vec_id").to_numpy(), matrix(sample.column("v"), d) if sample.num_rows else np.zeros((0, d))
    model = fit_index(sample_x if len(sample_x) else np.zeros((1, d)), n)
    n_lists = len(model.centroids)
    half, reach = (model.centroids**2).sum(axis=1) / 2, lengths(model.centroids)
    probes = max(1, math.ceil(probe_share * n_lists))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, radii = np.zeros(n_lists, np.int64), np.full(n_lists, -1.0)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                x = matrix(whole.column(0).slice(start, 1024), d)
                close = half - x @ model.centroids.T
                own = close.argmin(axis=1)
                sizes += np.bincount(own, minlength=n_lists)
                # Rounding may put a vector that is as near to other lists into any of these.
                off = slack(lengths(x)[:, None] + reach, d)
                row, at = np.nonzero(close - off <= close[np.arange(len(x)), own][:, None])
                np.maximum.at(radii, at, np.sqrt(((x - model.centroids[own]) ** 2).sum(axis=1)[row] + 4 * off[row, at]))
        at = np.flatnonzero(radii >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sizes[at]), pa.array(radii[at])], names=["list", "n", "radius"])

    counted = kept.select("v").mapInArrow(assigned, "list int, n long, radius double").groupBy("list").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
    sizes, radii = ({r["list"]: r[c] for r in counted} for c in ("n", "radius"))  # one row per list, at most MOST_LISTS
    rows = max(FEWEST_ROWS, min(group_rows, -(-n // FEWEST_GROUPS)))
    # The first group of each list, and the groups it is dealt out to if it is large.
    first, shards, now, filled = np.zeros(n_lists, np.int64), np.ones(n_lists, np.int64), 0, 0
    for i in range(n_lists):
        size = sizes.get(i, 0)
        if filled and filled + size > rows:
            now, filled = now + 1, 0
        first[i], shards[i] = now, max(1, -(-size // rows))
        now, filled = (now, filled + size) if shards[i] == 1 else (now + shards[i], 0)
    groups = int((first + shards).max())

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                lists, codes = model.codes(matrix(b.column(1), d))
                spread = b.column(2).to_numpy() % shards[lists]
                more = [int(i).to_bytes(4, "little") + c.tobytes() for i, c in zip(lists, codes, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(first[lists] + spread, pa.int32()), b.column(0), b.column(1), pa.array(more, pa.binary())], names=["g", "id", "v", "more"])

    kind = kept.schema["v"].dataType.simpleString()
    hashed = kept.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.spark_partition_id()), F.lit(1 << 30)).alias("h"))
    indexed = hashed.mapInArrow(index, f"g int, id long, v {kind}, more binary")
    most_own = kept.groupBy("vec_id").count().agg(F.max("count")).first()[0]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, radius = (np.array([of.get(i, none) for i in range(n_lists)]) for of, none in ((sizes, 0), (radii, -1.0)))
        sample_squares = (sample_x**2).sum(axis=1)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                q = matrix(b.column(1), d)
                size = lengths(q)[:, None]
                far = size**2 + sample_squares - 2 * q @ sample_x.T + slack(size + np.sqrt(sample_squares), d)
                far[b.column(0).to_numpy()[:, None] == sample_ids] = np.inf
                limits = np.sqrt(np.partition(far, k - 1, axis=1)[:, k - 1]) if len(sample_ids) >= k else np.full(len(q), np.inf)
                near = np.where(radius >= 0, half - q @ model.centroids.T, np.inf)
                order = np.argsort(near, axis=1, kind="stable")
                # Lists beyond the share are visited while those before them may hold fewer than k rows besides the query's,
                # and where they reach into the limit.
                chosen = (np.cumsum(held[order], axis=1) - held[order] < k + most_own) | (np.arange(n_lists) < probes)
                chosen |= np.take_along_axis(size**2 + 2 * near - 2 * slack(size + reach, d) <= (limits[:, None] + radius) ** 2, order, axis=1)
                of, g, more = [], [], []
                for i, row in enumerate(order):
                    visited: dict[int, list[int]] = {}
                    for c in row[chosen[i]]:
                        for s in range(shards[c] if radius[c] >= 0 else 0):
                            visited.setdefault(int(first[c]) + s, []).append(c)
                    of += [i] * len(visited)
                    g += visited
                    more += [limits[i].astype("<f8").tobytes() + np.array(v, "<i4").tobytes() for v in visited.values()]
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), *(b.column(j).take(pa.array(of, pa.int64())) for j in (0, 1)), pa.array(more, pa.binary())], names=["g", "id", "v", "more"])

    visits = asked.mapInArrow(visit, f"g int, id long, v {kind}, more binary")

    def build(t: pa.Table) -> Group:
        more = np.frombuffer(b"".join(t.column("more").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        return Group(model, t.column("id").to_numpy(), matrix(t.column("v"), d), more[:, :4].copy().view("<i4")[:, 0], more[:, 4:])

    def scan(group: Group, b: pa.RecordBatch) -> pa.RecordBatch:
        more = b.column("more").to_pylist()
        limits = np.array([np.frombuffer(v, "<f8", 1)[0] for v in more])
        visited = [np.frombuffer(v, "<i4", offset=8) for v in more]
        found, _ = group.search(b.column("id").to_numpy(), matrix(b.column("v"), d), visited, k, rerank, limits)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(found, HITS, strict=True)], schema=HITS)

    return best(streamed(indexed, visits, groups, build, scan, QUERY_STEP, "query_id long, vec_id long, score double"), k, ascending=True)
