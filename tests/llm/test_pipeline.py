import importlib.util
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lamina.llm.lines import brute_force
from lamina.llm.queries import ORACLE_SQL, QUERIES

pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else None
SF = "/root/testdata/sf0.001"


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.skipif(pipeline is None, reason="the pipeline is not there")
def test_stages(spark):
    from test_near import brute_force as near

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, None, "x", 0), (90_002, "12 34 !", "en", "x", 7)], docs.schema)
    docs = docs.union(odd)
    rows = {r.doc_id: r for r in docs.collect()}
    language, lines, duplicates, packing = (f for _, f in pipeline.STAGES)
    first = language(spark, docs, SF)
    kept = {r.doc_id: r.text for r in first.collect()}
    assert first.columns == docs.columns and not {90_001, 90_002} & set(kept) and len(kept) >= len(rows) - 3
    second = lines(spark, first, SF)
    want = brute_force(kept, 10)
    got = {r.doc_id: r for r in second.withColumn("sha", F.sha2("text", 256)).collect()}
    assert {i: r.sha for i, r in got.items()} == {i: w[2] for i, w in want.items()} and all(r.n_chars == len(r.text) for r in got.values())
    third = duplicates(spark, second, SF)
    left = {r.doc_id for r in third.collect()}
    assert left == {i for i, (_, _, stays) in near({i: r.text for i, r in got.items()}, 80).items() if stays} and third.columns == docs.columns
    pieces = packing(spark, third, SF).collect()
    total = Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    assert set(total) == left and all(total[r.doc_id] == r.doc_tokens for r in pieces)
    assert pipeline.run(spark, SF).count() > 0


@pytest.mark.skipif(pipeline is None, reason="the pipeline is not there")
def test_near_duplicates_go_by_row(spark):
    """Null ids and rows that share one: copies go, whatever their id, and other texts of the same id stay."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (7, a), (None, a), (3, a), (5, a + " more"), (5, b), (9, a), (9, c), (None, d), (None, d), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "x", 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert Counter(got) == Counter([(3, a), (5, b), (9, c), (None, d), (None, None), (None, "")])


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.skipif(pipeline is None, reason="the pipeline is not there")
def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == [] and (name == "packing" or out.columns == COLUMNS)


@pytest.mark.skipif(pipeline is None, reason="the pipeline is not there")
def test_stages_on_odd_rows(spark):
    """Very long texts, repeated rows and ids, null ids, ties and columns named like those that the stages work with."""
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("sun", "moon", "star") for b in ("light", "shine", "beam") for c in ("er", "ing", "s", "")]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(1000)) * (rng.random() < 0.3) for _ in range(n))
    long, plain, other = prose(150_000), prose(80), prose(90)
    rows = [(1, long), (2, long + " end"), (3, plain), (3, plain), (4, other), (4, prose(70)), (None, prose(60)), (None, plain), (5, None), (6, ""), (7, "common\n" + prose(50))]
    rows += [(10 + i, f"Common \n{prose(40)}") for i in range(10)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred int, score string, rejected string, n_lines string, n_dropped string, __rk string, __kept string, row string, place string, kept string, component_id string"
    docs = spark.createDataFrame([(i, t, "en", "x", len(t or ""), *[None] * 11) for i, t in rows], schema).repartition(5)
    language, lines, duplicates, packing = (f for _, f in pipeline.STAGES)
    first = language(spark, docs, SF)
    assert first.columns == COLUMNS and Counter(r.doc_id for r in first.collect()) == Counter(i for i, t in rows if t)
    second = lines(spark, docs, SF)
    held = Counter((r.doc_id, r.text, r.n_chars) for r in second.collect())
    cut = [(i, "\n".join(x for x in (t or "").split("\n") if x.strip().lower() != "common")) for i, t in rows]
    assert second.columns == COLUMNS and held == Counter((i, t, len(t)) for i, t in cut)
    third = duplicates(spark, docs, SF)
    left = Counter((r.doc_id, r.text) for r in third.collect())
    gone = [(2, long + " end"), (3, plain), (None, plain)]
    assert third.columns == COLUMNS and left == Counter(rows) - Counter(gone)
    pieces = packing(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(i for i, _ in rows)
    sequences = Counter()
    for r in pieces:
        sequences[r.sequence_id] += r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in sequences.values()) and max(r.length for r in pieces) == 2048
