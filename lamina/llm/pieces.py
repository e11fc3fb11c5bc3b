"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by longest-prefix matches in the model's compiled character map, with the source byte of every
normalised byte on record; pieces merged in the normalised text are projected back to byte spans of the source. Pieces
never hold a word mark after another character, so words are merged one by one and kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import Sink, bounded, rows

#: Fixed values of the model format: the word mark, piece types and the kind of model.
MARK = "▁"
MARK_BYTES = MARK.encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2
#: Words that a worker keeps, and their characters at most: some 60 MB in all.
WORDS, LONGEST = 200_000, 48

SPANS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_source_bytes", pa.int64())])


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + n]
        at += n


class CharMap:
    """A compiled character map: a double array of prefixes, each with its replacement."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest entry that data holds at this place."""
        if not self.units:
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node, found = offset(self.units[0]), None
        for n in range(at, len(data)):
            node ^= data[n]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[n]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = n + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.replacements[found[1] : self.replacements.index(0, found[1])]


class PieceEncoder:
    """Encodes as the sentencepiece library does for BPE models with byte fallback; no begin or end ids, no sampling."""

    def __init__(self, path: str, cache: int = WORDS):
        with open(path, "rb") as f:
            model = list(wire(f.read()))
        trainer, normalizer = (dict(wire(next((v for k, v in model if k == n), b""))) for n in (2, 3))
        self.pieces, scores, kinds = [], [], []
        for k, v in model:
            if k == 1:
                p = dict(wire(v))
                self.pieces.append(p[1].decode())
                scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kinds.append(p.get(3, NORMAL))
        if trainer.get(3, 1) != BPE_MODEL or not trainer.get(35) or trainer.get(24) or USER in kinds:
            raise ValueError("only BPE models with byte fallback, word marks in front and no user-defined pieces")
        self.map = CharMap(normalizer.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(normalizer.get(n, 1)) for n in (3, 4, 5))
        self.plain = not self.map.units and self.prefix and not self.squeeze and self.escape
        self.ids_of = {p: i for i, p in enumerate(self.pieces) if kinds[i] in (NORMAL, UNUSED)}
        if any(MARK in p.lstrip(MARK) for p in self.ids_of):
            raise ValueError("pieces must not hold a word mark after another character")
        self.scores = {p: scores[i] for p, i in self.ids_of.items()}
        self.byte_ids = [0] * 256
        surface: list[bytes] = []
        for i, (p, kind) in enumerate(zip(self.pieces, kinds, strict=True)):
            if kind == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
            surface.append(bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode())
        self.surface, self.is_byte = surface, [k == BYTE for k in kinds]
        self.spaced = [k in (NORMAL, UNUSED) and p.startswith(MARK) for p, k in zip(self.pieces, kinds, strict=True)]
        self.decimal = [str(i) for i in range(len(self.pieces))]
        chars = "".join(c for c in self.ids_of if len(c) == 1)
        self.runs = re.compile(f"[{re.escape(chars)}]+|.", re.S) if chars else re.compile(".", re.S)
        self.known = set(chars)
        self.merge, self.rank_ids = self._merger()
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.most = cache

    def _merger(self):
        """A rank merger over UTF-8 bytes: first the bytes of each known character join, then pieces by falling score."""
        import tiktoken

        ranks = {bytes([b]): b for b in range(256)}
        ids = [-1] * 256

        def put(key: bytes, i: int) -> None:
            if key in ranks:
                ids[ranks[key]] = max(ids[ranks[key]], i)
            else:
                ranks[key] = len(ids)
                ids.append(i)

        for c in sorted(self.known):
            data = c.encode()
            for n in range(2, len(data)):
                put(data[:n], -1)
            put(data, self.ids_of[c])
        for p in sorted((p for p in self.ids_of if len(p) > 1 and MARK * 2 not in p), key=lambda p: (-self.scores[p], self.ids_of[p])):
            put(p.encode(), self.ids_of[p])
        core = tiktoken.Encoding("merger", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        lengths = [0] * len(ids)
        for key, r in ranks.items():
            lengths[r] = len(key)
        self.rank_bytes = lengths
        return core.encode_single_piece, ids

    def _merge_marks(self, run: str) -> list[str]:
        """The same merging, the best score and then the leftmost pair first, for runs with several word marks in a row."""
        parts, right, left = list(run), [*range(1, len(run)), -1], [*range(-1, len(run) - 1)]
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (p := parts[a] + parts[b]) in self.scores:
                heapq.heappush(queue, (-self.scores[p], a, b, p))

        for a in range(len(run) - 1):
            offer(a, a + 1)
        while queue:
            _, a, b, p = heapq.heappop(queue)
            if not parts[a] or not parts[b] or parts[a] + parts[b] != p or right[a] != b:
                continue
            parts[a], parts[b] = p, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p]

    def segment(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a normalised run that starts a word, and the normalised bytes that each covers."""
        ids, sizes = [], []
        for run in self.runs.findall(text):
            if run[0] not in self.known:
                data = run.encode()
                ids += [self.byte_ids[b] for b in data]
                sizes += [1] * len(data)
            elif MARK * 2 in run:
                found = self._merge_marks(run)
                ids += [self.ids_of[p] for p in found]
                sizes += [len(p.encode()) for p in found]
            else:
                found = self.merge(run.encode())
                ids += [self.rank_ids[r] for r in found]
                sizes += [self.rank_bytes[r] for r in found]
        return ids, sizes

    def word(self, w: str) -> tuple[bytes, bytes]:
        """Ids and normalised bytes of one marked word, packed as unsigned 32-bit integers."""
        out = self.words.get(w)
        if out is None:
            ids, sizes = self.segment(MARK + w)
            out = struct.pack(f"<{len(ids)}I", *ids), struct.pack(f"<{len(sizes)}I", *sizes)
            if len(w) <= LONGEST:
                if len(self.words) >= self.most:
                    self.words.clear()
                self.words[w] = out
        return out

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normal form, and for each of its bytes and its end the source byte where it begins."""
        out, align = bytearray(), []

        def step(at: int) -> tuple[int, bytes]:
            if m := self.map.longest(data, at):
                return m
            n = 1
            while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                n += 1
            return n, data[at : at + n]

        at, end, space = 0, len(data), MARK_BYTES if self.escape else b" "
        if self.squeeze:
            while at < end and (m := step(at))[1] == b" ":
                at += m[0]
        if at == end:
            return b"", np.zeros(1, np.int64)
        if self.prefix:
            out += space
            align += [at] * len(space)
        was_space = self.squeeze
        while at < end:
            n, got = step(at)
            if self.squeeze:
                while was_space and got.startswith(b" "):
                    got = got[1:]
            if got:
                was_space = self.squeeze and got.endswith(b" ")
                got = got.replace(b" ", space)
                out += got
                align += [at] * len(got) if self.map.units else range(at, at + n) if len(got) == n else [at] * len(got)
            at += n
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
            at = align[len(out)] if len(out) < len(align) else at
        return bytes(out), np.array([*align[: len(out)], at], np.int64)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the source byte offsets between them: piece i covers the bytes from offsets[i] to offsets[i + 1]."""
        if not text:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if self.plain and text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
            found = [self.words.get(w) or self.word(w) for w in text.split(" ")]
            ids = np.frombuffer(b"".join([f[0] for f in found]), "<u4")
            sizes = np.frombuffer(b"".join([f[1] for f in found]), "<u4").astype(np.int64)
            sizes[self._marked()[ids]] -= 2  # a word mark stands for one blank
            sizes[0] -= 1  # the first one stands for nothing
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        if self.plain:  # identity: only blanks change their size
            normal = MARK + text.replace(" ", MARK)
            align = None
        else:
            data, align = self.normalize(text.encode())
            normal = data.decode("utf-8", "replace")
        ids, sizes = [], []
        for part in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", normal):
            i, n = self.segment(part)
            ids += i
            sizes += n
        ends = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)
        if align is None:
            source = np.frombuffer(text.encode(), np.uint8)
            width = np.where(source == 32, 3, 1)  # a blank became three bytes
            align = np.concatenate([[0, 0, 0], np.repeat(np.arange(len(source)), width), [len(source)]])
        return np.array(ids, np.uint32), align[ends]

    def _marked(self) -> np.ndarray:
        if not hasattr(self, "marked"):
            self.marked = np.array(self.spaced)
        return self.marked

    def ids(self, text: str | None) -> bytes:
        return self.encode(text)[0].astype("<u4").tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library's decode(ids) gives it."""
        first = 0
        while first < len(ids) and not self.surface[ids[first]]:
            first += 1
        data = b"".join(map(self.surface.__getitem__, ids))
        if self.prefix and first < len(ids) and self.spaced[ids[first]]:
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(data):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(data[at : at + n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n, _ = 1, out.append("�")
                at += n
            return "".join(out)


_made: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One per worker process and model."""
    if path not in _made:
        _made[path] = PieceEncoder(path)
    return _made[path]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bounded(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")))


def encode_documents(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, starts, ends: every piece with its byte span [start, end) in the source text's UTF-8.

    Defined cases: a null or empty text has no pieces; null ids and repeated rows stay; an empty table gives no rows;
    other columns are ignored; the mark that the model puts before a text spans no bytes; a character outside the
    vocabulary gives one piece for each of its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sink = piece_encoder(model).encode, Sink(SPANS)
        for key, text in rows(batches):
            ids, at = encode(text)
            if sink.add(key, ids.astype(np.int32), at[:-1], at[1:], size=20 * len(ids)):
                yield sink.batch()
        if sink.n:
            yield sink.batch()

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def decode_documents(encoded: DataFrame, model: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the decoded text of each list of ids; null ids give an empty text."""
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, sink = piece_encoder(model).decode, Sink(out)
        for key, ids in rows(batches):
            text = decode(ids or [])
            if sink.add(key, text, size=len(text)):
                yield sink.batch()
        if sink.n:
            yield sink.batch()

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_source_bytes (bytes that the spans cover) of encoding, then decoding.

    Both steps run in one pass over the texts, so no list of ids leaves its worker. Defined cases as in encode_documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sink = piece_encoder(model), Sink(DIGESTS)
        decimal = coder.decimal.__getitem__
        for key, text in rows(batches):
            ids, at = coder.encode(text)
            found = ids.tolist()
            if sink.add(key, len(found), hashlib.sha256(",".join(map(decimal, found)).encode()).hexdigest(), hashlib.sha256(coder.decode(found).encode()).hexdigest(), int(at[-1])):
                yield sink.batch()
        if sink.n:
            yield sink.batch()

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_source_bytes long")
