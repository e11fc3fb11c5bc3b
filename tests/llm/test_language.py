import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm.language import fit, held_out, identify, ngram_counts

PARTS = {"aa": ["lo", "mi", "ka", "nu"], "bb": ["sch", "ung", "heit", "tz"], "cc": ["qui", "eau", "oir", "ç"]}


def text(lang, words, rng):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(i, text(lang, rng.randint(3, 60), rng), lang, "x") for i, lang in enumerate(rng.choice(list(PARTS)) for _ in range(400))]


SCHEMA = "doc_id long, text string, lang string, score string"


def test_accuracy_on_held_out_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    model = fit(df.where(~held_out(df.doc_id)))
    got = identify(df, model).withColumn("out", held_out(F.col("doc_id"))).where("out").collect()
    assert len(got) > 80 and np.mean([r.lang == r.lang_pred for r in got]) > 0.99 and all(0 <= r.score <= 1 for r in got)
    assert not any(r.rejected for r in got)


def test_sample_bound_and_repetition(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    small, again = fit(df, per_language=20), fit(df.repartition(3), per_language=20)
    assert np.allclose(small.centroids, again.centroids) and small.languages == again.languages == sorted(small.languages)
    assert all(small.languages.count(x) <= 4 for x in PARTS)


def test_odd_texts(spark, rows):
    model = fit(spark.createDataFrame(rows, SCHEMA))
    odd = [None, "", "123 ... !?", "日本語日本語", "lomi", "LOMIKA nulo", "lomi " * 300_000]
    got = identify(spark.createDataFrame([(None if i == 4 else i, t, None, "s") for i, t in enumerate(odd)] * 2, SCHEMA), model).collect()
    assert len(got) == 14
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in PARTS
    assert {r.lang_pred for r in got if r.text and "lomi" in r.text.lower()} == {"aa"}
    assert {r.rejected for r in got if r.text == "日本語日本語"} == {True}


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "abc", None, None)], SCHEMA)
    model = fit(df)
    assert [(r.lang_pred, r.rejected) for r in identify(df, model).collect()] == [("und", True)] and identify(df.limit(0), model).collect() == []


def test_counts_do_not_depend_on_slices(monkeypatch):
    import lamina.llm.language as module
    from lamina.llm.shared import text_slices

    data = "straße und mehr, viel 12 mehr " * 40
    whole = ngram_counts(data)
    monkeypatch.setattr(module, "text_slices", lambda b: text_slices(b, 50))
    assert (ngram_counts(data) == whole).all() and whole.sum() > 0


def test_fold(spark):
    import zlib

    got = spark.range(200).withColumn("out", held_out(F.col("id"))).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def plain_vector(text, idf=None):
    """Hashed counts of byte n-grams, then TF-IDF of length 1, in plain Python."""
    letters = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
    data = b" " + b" ".join(letters.split()) + b" "
    counts = {}
    for n, mark in ((1, 1 << 31), (2, 1 << 30), (3, 0)):
        for at in range(len(data) - n + 1):
            bucket = ((int.from_bytes(data[at : at + n], "big") | mark) * 2654435761 % (1 << 32)) >> 19
            counts[bucket] = counts.get(bucket, 0) + 1
    if idf is None:
        return counts
    v = {b: math.log1p(c) * idf[b] for b, c in counts.items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    return {b: x / size for b, x in v.items()}


def test_against_brute_force(spark, rows):
    """Counts, document frequencies, vectors, cosines and the nearest centroid, computed apart from the operator."""
    df = spark.createDataFrame(rows, SCHEMA)
    model = fit(df, per_language=10**6)
    df_of = Counter(b for r in rows for b in plain_vector(r[1]))
    idf = {b: math.log((1 + len(rows)) / (1 + df_of.get(b, 0))) + 1 for b in range(1 << 13)}
    assert np.allclose(model.idf, [idf[b] for b in range(1 << 13)])
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1)
    got = {r.doc_id: r for r in identify(df, model).collect()}
    nearest = []
    for i, text_, _, _ in rows:
        assert {int(b): int(c) for b, c in enumerate(ngram_counts(text_)) if c} == plain_vector(text_)
        v = plain_vector(text_, idf)
        cosines = [sum(x * c[b] for b, x in v.items()) for c in model.centroids.tolist()]
        best = max(range(len(cosines)), key=lambda j: cosines[j])
        nearest.append(best)
        assert got[i].lang_pred == model.languages[best] and got[i].score == pytest.approx(cosines[best]) and got[i].rejected == (cosines[best] < model.reject)
    # Each centroid lies at the mean of the texts that are nearest to it.
    for j, c in enumerate(model.centroids):
        own = [plain_vector(r[1], idf) for r, b in zip(rows, nearest, strict=True) if b == j]
        mean = np.zeros(1 << 13)
        for v in own:
            for b, x in v.items():
                mean[b] += x
        assert not own or float(mean @ c / np.linalg.norm(mean)) > 0.99


def test_labels_beyond_a_limit(spark):
    df = spark.createDataFrame([(i, f"{'abcdefgh'[i % 8] * 5} {'abcdefgh'[i % 8] * 3}", f"l{i % 8}", "") for i in range(64)] + [(99, "zzzz zz", "odd", "")], SCHEMA)
    assert len(set(fit(df).languages)) == 9 and len(set(fit(df, most_languages=8).languages)) == 8
