import math
from collections import defaultdict

import numpy as np
import pytest

from lamina.llm.ann import Group, IvfPq, fit_index, search
from lamina.llm.impact import ImpactIndex, floors, integers, top_k

SCHEMA = "vec_id long, embedding array<float>, score string"


def rows(n=600, d=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[5]  # a third of all rows are one vector
    return [(int(i), [float(v) for v in r], "clash") for i, r in enumerate(x)]


ODD = [(9001, None, "n"), (9002, [], "e"), (9003, [float("nan")] * 16, "n"), (9004, [float("inf")] + [0.0] * 15, "i"), (9005, [None] + [0.0] * 15, "n"), (9006, [1.0] * 7, "short"), (None, [1.0] * 16, "id"), (9100, [0.0] * 16, "zero")]


def queries(df):
    return df.where("vec_id % 100 = 0")


def test_exact_top_k(spark):
    data = rows()
    df = spark.createDataFrame(data + ODD, SCHEMA).repartition(5)
    kept = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v, _ in data} | {9100: np.zeros(16, np.int64)}
    got = defaultdict(list)
    for r in sorted(top_k(df, queries(df)).collect()):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in kept if i % 100 == 0}
    for q, found in got.items():
        want = sorted(((-int(kept[q] @ v), i) for i, v in kept.items() if i != q))[:10]
        assert found == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_processing_stops_on_proof_only():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-50, 50, (3000, 8)), rng.integers(500, 1000, (60, 8))])
    ids = np.arange(len(x))
    q = np.abs(x[-3:]) + 1
    q_ids, found, scores, skipped = ImpactIndex(ids, x).search(ids[-3:], q, 10)
    assert skipped > 0  # the strong vectors were proven after a few planes
    for n in range(3):
        full = x @ q[n]
        full[len(x) - 3 + n] = -(1 << 60)
        want = np.lexsort((ids, -full))[:10]
        assert found[q_ids == ids[-3 + n]].tolist() == want.tolist() and scores[q_ids == ids[-3 + n]].tolist() == full[want].tolist()


def test_small_and_huge(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], ""), (1, [3.0, -1.0], ""), (100, [0.0, 0.0], "")], SCHEMA)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(few, queries(few)).collect()) == [(0, 1, 1, 1024 * 1024), (0, 2, 100, 0), (100, 1, 0, 0), (100, 2, 1, 0)]
    assert top_k(few.limit(0), few).collect() == [] and search(few.limit(0), few).collect() == []
    assert top_k(few, few.limit(0)).collect() == []
    big = ImpactIndex(np.arange(3), np.array([[1 << 40], [1 << 41], [3]]))  # partial scores would not be exact: all are rescored
    assert big.search(np.array([9]), np.array([[1 << 18]]), 2)[1].tolist() == [1, 0]


def test_neighbours(spark):
    data = rows()
    df = spark.createDataFrame(data + ODD, SCHEMA).repartition(4)
    kept = {i: np.array(v, np.float64) for i, v, _ in data}
    got = defaultdict(list)
    for r in sorted(search(df, queries(df)).collect()):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in (i for i in kept if i % 100 == 0):
        want = sorted((math.sqrt(float(((kept[q] - v) ** 2).sum())), i) for i, v in kept.items() if i != q)[:10]
        assert [n for n, _, _ in got[q]] == list(range(1, 11)) and [(s, i) for _, i, s in got[q]] == sorted((s, i) for _, i, s in got[q])
        for _, i, s in got[q]:
            assert s == pytest.approx(math.sqrt(float(((kept[q] - kept[i]) ** 2).sum())), abs=1e-12)
        hits += len({i for _, i, _ in got[q]} & {i for _, i in want})
        total += 10
        if q in range(300, 500):  # a copy of the hot vector: ties go to the smaller ids
            assert [i for _, i, _ in got[q]] == [i for i in [5, *range(300, 500)] if i != q][:10]
    assert hits / total >= 0.9


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], ""), (1, [1.0, 0.0], ""), (7, [4.0, 4.0], ""), (100, [0.0, 0.0], "")], SCHEMA)
    got = search(df, queries(df)).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in sorted(got)] == [(0, 1, 0.0), (0, 7, 5.0)]
    one = spark.createDataFrame([(0, [1.0], "")], SCHEMA)
    assert search(one, one).collect() == []


def test_asymmetric_distances():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 10))
    model = fit_index(x, len(x))
    lists, codes = model.codes(x)
    assert isinstance(model, IvfPq) and codes.shape == (500, 3)
    own = lists == lists[0]
    guess = model.distances(x[:1], lists[0], codes[own])[0]
    books = np.stack([model.books[j][codes[own][:, j]] for j in range(3)], axis=1).reshape(own.sum(), -1)[:, :10]
    assert np.allclose(guess, ((x[0] - model.centroids[lists[0]] - books) ** 2).sum(axis=1))


def test_few_candidates_in_the_nearest_lists(spark):
    """All but three vectors are copies of a far one, in a list that the share of the lists does not reach."""
    rows = [(i, [0.0, 1.0 + i], "") for i in range(3)] + [(i, [900.0, 900.0], "") for i in range(3, 1000)]
    df = spark.createDataFrame(rows + [(0, [0.0, 1.0], "")], SCHEMA).repartition(3)
    got = sorted((r["rank"], r.vec_id) for r in search(df, df.where("vec_id = 1")).collect())
    assert [i for _, i in got] == [0, 0, 2, *range(3, 10)]
    once = sorted((r["rank"], r.vec_id) for r in search(df, df.where("vec_id = 0").limit(1)).collect())
    assert [i for _, i in once] == [1, 2, *range(3, 11)]


def test_visiting_all_lists_is_exact(spark):
    df = spark.createDataFrame(rows(300, 8, 4), SCHEMA).repartition(4)
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect()}
    got = defaultdict(list)
    for r in sorted(search(df, queries(df), probe_share=1.0, rerank=300, group_rows=40).collect()):
        got[r.query_id].append(r.vec_id)
    for q, found in got.items():
        assert found == [i for _, i in sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in x.items() if i != q)[:10]]


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_with_production_parameters(spark, sf):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    held = df.collect()
    ids, x = np.array([r.vec_id for r in held]), np.array([r.embedding for r in held], np.float64)
    got = defaultdict(set)
    for r in search(df, queries(df)).collect():
        got[r.query_id].add(r.vec_id)
    hits = total = 0
    for at in np.flatnonzero(ids % 100 == 0):
        far = ((x - x[at]) ** 2).sum(axis=1)
        far[at] = np.inf
        want = set(ids[np.lexsort((ids, far))[:10]].tolist())
        hits, total = hits + len(want & got[ids[at]]), total + 10
    assert total and hits / total >= 0.9


def other_rows(kind):
    """Vectors of several shapes, in the order of their ids."""
    rng = np.random.default_rng(21)
    if kind == "few":  # no structure, and lists of a few vectors each
        return rng.normal(size=(120, 64))
    if kind == "families":  # more of them than lists, each of more vectors than are measured at first, nearer than codes tell
        return (rng.normal(size=(150, 16))[:, None] + 1e-3 * rng.normal(size=(150, 80, 16))).reshape(-1, 16)[rng.permutation(12000)]
    if kind == "far":  # lengths of many scales, all beside one far point
        return 50 + rng.normal(size=(3000, 16)) * np.exp(3 * rng.normal(size=(3000, 1)))
    return rng.integers(0, 2, size=(2000, 12)).astype(float)  # ties


@pytest.mark.parametrize("kind", ["few", "families", "far", "ties"])
def test_other_rows_lose_no_neighbour(spark, kind):
    x = other_rows(kind).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    x, part = x.astype(np.float64), (x != 0).any(axis=1)
    got = defaultdict(list)
    for r in sorted(search(df, queries(df)).collect()):
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, len(x), 100):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q], far[~part] = np.inf, np.inf
        assert got[q] == [(i, far[i]) for i in np.lexsort((np.arange(len(x)), far))[:10]] if part[q] else q not in got


def test_codes_choose_what_is_measured():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 16))
    model = fit_index(x, len(x))
    lists, codes = model.codes(x)
    group = Group(model, np.arange(4000), x, lists, codes)
    every = [np.unique(lists)] * 20
    found, measured = group.search(np.arange(20), x[:20], every, 10, 64)
    assert measured == 20 * 64
    far = ((x[:20, None] - x[None]) ** 2).sum(axis=2)
    far[np.arange(20), np.arange(20)] = np.inf
    want = np.argsort(far, axis=1)[:, :10]
    assert sum(len(set(w) & set(f.tolist())) for w, f in zip(want, found[1], strict=True)) >= 180
    assert group.search(np.array([0]), x[:1], [np.zeros(0, int)], 10, 64)[1] == 0


def test_planes_floors_and_ranges(spark):
    """Whatever the values' size, sign and number, and whether a floor is known: the same as brute force."""
    rng = np.random.default_rng(6)
    for high, n in ((3, 40), (1000, 900), (1 << 20, 500), (1, 5)):
        x = rng.integers(-high, high, (n, 6))
        x[n // 3 : n // 2] = x[0]
        ids = rng.permutation(n)
        q, q_ids = x[:8], ids[:8]
        index = ImpactIndex(ids, x)
        for floor in (None, floors(q_ids, q, ids[::3], x[::3], 4)):
            of, found, scores, _ = index.search(q_ids, q, 4, floor)
            for i in range(len(q)):
                full = x @ q[i]
                want = [j for j in np.lexsort((ids, -full)) if ids[j] != q_ids[i]][:4]
                assert found[of == q_ids[i]].tolist() == ids[want].tolist() and scores[of == q_ids[i]].tolist() == full[want].tolist()
    with pytest.raises(ValueError):
        integers(np.array([[2.0**50]]), 1024)
    with pytest.raises(ValueError):
        ImpactIndex(np.arange(2), np.array([[1 << 40], [1]])).search(np.array([7]), np.array([[1 << 40]]), 1)
    huge = spark.createDataFrame([(0, [2.0**30], ""), (1, [2.0**30], "")], "vec_id long, embedding array<double>, score string")
    with pytest.raises(Exception, match="64 bits"):
        top_k(huge, huge).collect()


def test_a_repeated_id_and_queries_beyond_a_step(spark):
    rng = np.random.default_rng(12)
    data = [(i if i % 3 else 7, [float(v) for v in rng.normal(size=4)], "") for i in range(1, 900)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string").repartition(6)
    asked = df.where("vec_id % 4 = 1")
    kept = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v, _ in data]
    got = defaultdict(list)
    for r in sorted(top_k(df, asked, group_rows=50).collect()):
        got[r.query_id].append((r.vec_id, r.score))
    for q, v in kept:
        if q % 4 == 1:
            assert got[q] == [(i, -s) for s, i in sorted((-int(v @ x), i) for i, x in kept if i != q)[:10]]
