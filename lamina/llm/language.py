"""Language ID by nearest centroids: TF-IDF n-gram vectors of whole texts against several centroids of each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Sink, bounded, rows, text_slices

#: Hash buckets of the byte n-grams of one to three bytes.
BUCKETS_LOG2 = 13
#: Bounds of the fitting sample: texts of a language (about), centroids of a language.
SAMPLE_PER_LANGUAGE, CENTROIDS = 400, 4
#: Share of the smallest cosine that a sample text has to its own language, below which a text is rejected.
REJECT_SHARE = 0.25
#: Texts whose vectors are laid out at once.
STEP = 64
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of a text's byte n-grams: lower case, whatever ASCII is no letter as one blank."""
    size, shift = 1 << BUCKETS_LOG2, np.uint32(32 - BUCKETS_LOG2)
    out, before = np.zeros(size), np.zeros(0, np.uint32)
    for part in text_slices(text.lower().encode()):
        words = part.translate(_KEEP).split()
        if not words:
            continue
        lead = b"" if len(before) else b" "
        a = np.frombuffer(lead + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
        a = np.concatenate([before, a])
        new = len(before)
        two = (a[:-1] << np.uint32(8)) | a[1:]
        three = (two[:-1] << np.uint32(8)) | a[2:]
        for grams in (a[new:] | np.uint32(1 << 31), two[max(0, new - 1) :] | np.uint32(1 << 30), three[max(0, new - 2) :]):
            out += np.bincount((grams * np.uint32(2654435761)) >> shift, minlength=size)
        before = a[-2:]
    return out


@dataclass
class CentroidModel:
    """languages[i] is the language of row i of centroids; idf weighs buckets; below reject a text is unlike all."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    reject: float

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected); und, 0 and rejected for null, for a text without letters and for an empty model."""
        out: list[tuple[str, float, bool]] = [(UNDETERMINED, 0.0, True)] * len(texts)
        every = [i for i, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        for first in range(0, len(every), STEP):
            live = every[first : first + STEP]
            cosines = self.vectors(np.array([ngram_counts(texts[i]) for i in live])) @ self.centroids.T
            for i, best, c in zip(live, cosines.argmax(axis=1), cosines.max(axis=1), strict=True):
                out[i] = self.languages[best], float(min(max(c, 0.0), 1.0)), bool(c < self.reject)
        return out


def _clusters(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first starts; deterministic."""
    starts = [v.mean(axis=0)]
    starts[0] = v[int((v @ starts[0]).argmax())]
    while len(starts) < min(k, len(v)):
        near = (v @ np.array(starts).T).max(axis=1)
        if near.min() > 1 - 1e-9:
            break
        starts.append(v[int(near.argmin())])
    c = np.array(starts)
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = np.array([v[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit_counts(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]], centroids: int = CENTROIDS) -> CentroidModel:
    """From (buckets, counts) of labelled texts; the texts of one language are laid out at a time. Ties between languages
    go to the smaller name."""
    n, size = len(languages), 1 << BUCKETS_LOG2
    held = np.zeros(size)
    for at, _ in counts:
        held[at] += 1
    idf = np.log((1 + n) / (1 + held)) + 1 if n else np.ones(size)
    model = CentroidModel([], np.zeros((0, size)), idf, 0.0)
    if not n:
        return model
    parts, worst = [], 1.0
    own_of: dict[str, list[int]] = {}
    for i, name in enumerate(languages):
        own_of.setdefault(name, []).append(i)
    for name in sorted(own_of):
        own = np.zeros((len(own_of[name]), size))
        for row, i in zip(own, own_of[name], strict=True):
            row[counts[i][0]] = counts[i][1]
        own = model.vectors(own)
        c = _clusters(own, centroids)
        parts.append(c)
        model.languages += [name] * len(c)
        worst = min(worst, float((own @ c.T).max(axis=1).min()))
    model.centroids, model.reject = np.concatenate(parts), REJECT_SHARE * worst
    return model


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS, most_languages: int | None = None) -> CentroidModel:
    """Fits on a bounded sample of labelled rows: of each language a share of rows, chosen by the hash of their ids,
    that makes about per_language; only sparse counts come to the driver. Null texts, labels and ids are left out.
    most_languages limits the fit to the most frequent labels, for label columns that hold noise; as it stands all count.
    """
    known = labelled.select(labelled[id_col].alias("id"), labelled[text_col].cast("string").alias("text"), labelled[lang_col].cast("string").alias("lang")).dropna()
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    sizes = (sizes.limit(most_languages) if most_languages else sizes).collect()  # one row per label
    if not sizes:
        return fit_counts([], np.zeros((0, 1 << BUCKETS_LOG2)))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["n"]))])
    place = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(place < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))
    schema = pa.schema([("id", pa.string()), ("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(schema)
        for key, text, lang in rows(batches):
            if _LETTER.search(text):
                c = ngram_counts(text)
                at = np.flatnonzero(c)
                if sink.add(key, lang, at.astype("<u2").tobytes(), c[at].astype("<f4").tobytes(), size=6 * len(at)):
                    yield sink.batch()
        if sink.n:
            yield sink.batch()

    got = sorted(bounded(sample.select(F.col("id").cast("string"), "text", "lang")).mapInArrow(run, "id string, lang string, at binary, n binary").collect())
    counts = [(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], "<f4")) for r in got]
    return fit_counts([r["lang"] for r in got], counts, centroids)


def identify(docs: DataFrame, model: CentroidModel, *, text_col: str = "text", lang_pred: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """docs with the predicted language, its cosine (0 to 1) and whether the text is too far from every centroid.

    Only the text is read. Defined cases: null, empty and letterless texts are und with score 0 and rejected; a tie goes
    to the smaller language name; a model without languages rejects all; repeated rows stay; docs' own columns of the
    result's names are replaced; an empty table gives no rows.
    """
    docs = docs.drop(lang_pred, score, rejected)
    names = docs.columns
    kinds = ", ".join(f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found = model.predict(b.column(text_col).to_pylist())
                new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*names, lang_pred, score, rejected])

    return bounded(docs).mapInArrow(run, f"{kinds}, `{lang_pred}` string, `{score}` double, `{rejected}` boolean")


def held_out(doc_id) -> F.col:
    """The fold that a model must not learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
