"""Packing by lexical retrieval: a sharded BM25 inverted index fills each window with the seed's unused neighbours.

Documents arrive as the files hold them; each task cuts its rows into shards of a bounded number of tokens, so nothing
is shuffled, no shard grows with the corpus and a lost task is repeated alone, with the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import Sink, bounded, rows
from .wordbpe import word_bpe

#: Tokens of a shard, after which a document starts the next one.
SHARD_TOKENS = 2_000_000
#: Neighbours that a seed's first request returns; each further one returns twice as many.
NEIGHBOURS = 16
K1, B = 1.2, 0.75
#: Terms that more than one in DENSE_SHARE documents of a shard holds have a row over all of these.
DENSE_SHARE = 8

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_IDS = PIECES.append(pa.field("ids", pa.list_(pa.int32())))


class Bm25Shard:
    """The inverted index of one shard; terms are token ids."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        parts = [np.unique(d, return_counts=True) for d in docs]
        self.at = np.concatenate([[0], np.cumsum([len(t) for t, _ in parts])])
        terms = np.concatenate([t for t, _ in parts]).astype(np.int64) if n else np.zeros(0, np.int64)
        tf = np.concatenate([c for _, c in parts]).astype(np.float64) if n else np.zeros(0)
        owner = np.repeat(np.arange(n), np.diff(self.at))
        df = np.bincount(terms, minlength=1)
        size = np.array([len(d) for d in docs], float)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(size.mean() if n else 1.0, 1e-9))
        self.weight = idf[terms] * tf * (K1 + 1) / (tf + norm[owner])
        self.terms = terms
        order = np.argsort(terms.astype(np.uint16) if len(df) <= 65536 else terms, kind="stable")
        self.docs, self.impact = owner[order], self.weight[order]
        self.ptr = np.concatenate([[0], np.cumsum(df)])
        self.unused = np.ones(n, bool)
        # Long posting lists are kept as rows over all documents, which add up faster; terms that no other document
        # holds find nothing.
        long = np.flatnonzero(df * DENSE_SHARE > max(n, DENSE_SHARE))
        self.row = np.full(len(df), -1)
        self.row[long] = np.arange(len(long))
        self.dense = np.zeros((len(long), n), np.float32)
        kept = self.row[terms] >= 0
        self.dense[self.row[terms[kept]], owner[kept]] = self.weight[kept]
        self.listed = (df > 1) & (self.row < 0)

    def scores(self, seed: int) -> np.ndarray:
        """Of all documents, by all terms of the seed."""
        asked = self.terms[self.at[seed] : self.at[seed + 1]]
        rows = self.row[asked]
        out = self.dense[rows[rows >= 0]].sum(axis=0, dtype=np.float32).astype(np.float64)
        terms = asked[self.listed[asked]]
        parts = [slice(a, b) for a, b in zip(self.ptr[terms].tolist(), self.ptr[terms + 1].tolist(), strict=True)]
        if parts:
            out += np.bincount(np.concatenate([self.docs[p] for p in parts]), np.concatenate([self.impact[p] for p in parts]), len(out))
        return out

    def best(self, score: np.ndarray, most: int) -> np.ndarray:
        """Unused documents of the highest scores above 0, best first; ties go to the earlier document."""
        score[~self.unused] = 0
        least = np.partition(score, -most)[-most] if len(score) > most else 0
        top = np.flatnonzero((score >= least) & (score > 0))
        return top[np.lexsort((top, -score[top]))][:most]

    def neighbours(self, seed: int) -> np.ndarray:
        """The first unused documents that share terms with the seed."""
        return self.best(self.scores(seed), NEIGHBOURS)


class Packer:
    """Fills windows of one task. A document that does not fit is cut; its rest seeds the next window."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.next, self.open, self.filled = window, first_sequence, [], 0

    def put(self, key, ids: np.ndarray) -> Iterator[tuple]:
        total, at = len(ids), 0
        while at < total:
            n = min(total - at, self.window - self.filled)
            self.open.append((key, at, ids[at : at + n], total))
            at, self.filled = at + n, self.filled + n
            if self.filled == self.window:
                yield from self._close(self.open)
                self.open, self.filled = [], 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for key, start, ids, total in pieces:
            yield key, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset, ids
            offset += len(ids)
        self.next += 1

    def end(self) -> Iterator[tuple]:
        """The last window, cut into sequences whose lengths are powers of two: they need no padding."""
        left, at = list(self.open), 0
        while self.filled:
            room = 1 << (self.filled.bit_length() - 1)
            self.filled -= room
            taken = []
            while room:
                key, start, ids, total = left[at]
                n = min(room, len(ids))
                taken.append((key, start, ids[:n], total))
                left[at] = (key, start + n, ids[n:], total)
                at, room = at + (n == len(ids)), room - n
            yield from self._close(taken)
        self.open = []

    def shard(self, keys: list, docs: list[np.ndarray]) -> Iterator[tuple]:
        index, ahead = Bm25Shard(docs), 0
        wanted, score, most = [], None, NEIGHBOURS
        while True:
            while ahead < len(docs) and not index.unused[ahead]:
                ahead += 1
            wanted = [d for d in wanted if index.unused[d]]
            if not wanted and score is not None:  # the window is not full: the same seed's next neighbours
                wanted, most = list(index.best(score, most)), 2 * most
            if not wanted and ahead == len(docs):
                return
            fresh = not wanted or len(docs[wanted[0]]) > self.window - self.filled
            doc = wanted.pop(0) if wanted else ahead
            index.unused[doc] = False
            yield from self.put(keys[doc], docs[doc])
            if fresh or not self.open:  # it opened this window: its neighbours come next
                wanted, most, score = [], NEIGHBOURS, index.scores(doc) if self.open else None


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, with_ids: bool = False, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every id of every document lies in exactly one piece; all sequences hold exactly window ids except the last few of a
    task, whose lengths are powers of two, so there is no padding. Within a task sequence ids are dense, between tasks unique.

    Defined cases: a null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed each;
    an empty table gives no rows; other columns are ignored; ties in score go to the row read first; a text longer than
    a shard is a shard of its own.
    """
    schema = PIECES_IDS if with_ids else PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_bpe(tokenizer).encode
        last = int(end_id).to_bytes(4, "little")
        packer, sink = Packer(window, TaskContext.get().partitionId() << 33), Sink(schema)
        keys, ids, held = [], [], 0

        def out(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for p in pieces:
                if sink.add(*(p if with_ids else p[:-1]), size=60 + 4 * p[2] * with_ids):
                    yield sink.batch()

        for key, text in rows(batches):
            keys.append(key)
            ids.append(np.frombuffer(encode(text) + last, "<u4"))
            held += len(ids[-1])
            if held >= shard_tokens:
                yield from out(packer.shard(keys, ids))
                keys, ids, held = [], [], 0
        if keys:
            yield from out(packer.shard(keys, ids))
        yield from out(packer.end())
        if sink.n:
            yield sink.batch()

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return bounded(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))).mapInArrow(run, kinds)
