"""Exact, cached tokenization for tokenizer files of the kind "BPE with word ends".

White space never joins two tokens of such a tokenizer, so the ids of a text are the ids of its chunks between ASCII
white space. Chunks are kept in a bounded cache. A chunk of plain Latin characters is lowered, split by the file's own
pattern and merged by rank; any other chunk goes through the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re

import regex

from .shared import text_slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The split pattern and the normaliser that the fast path stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
#: Chunks that a worker keeps, and their bytes at most: some 60 MB in all.
CHUNKS, LONGEST = 300_000, 48
_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_SIGNS = b".,;:!?*%$#&()-"
_PLAIN = re.compile(rb"[\x21-\x7e]+")
#: Composed Latin letters and signs: no combining marks, one lower-case character each.
_LATIN = re.compile("[\x21-\x7e¡-įı-ſ]+")
_SPLIT = regex.compile(PATTERN)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else extra))
        extra += b not in printable
    return out


class Chunks(dict):
    """chunk -> its ids as little-endian unsigned 32-bit bytes; starts anew at the bound, and holds no long chunks."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, chunk: bytes) -> bytes:
        out = self.encode(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = out
        return out


class WordBpe:
    """Ids of whole texts, equal to tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str, cache: int = CHUNKS):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.path, self.library = path, None
        self.marks = [t["content"].encode() for t in self.spec["added_tokens"]]
        self.fast = self._merger()
        self.chunks = Chunks(self.encode_chunk, cache)

    def _merger(self):
        """A rank merger over bytes with the mark 0xFF, which UTF-8 never holds, as word end; None for files of another kind."""
        import tiktoken

        model, pre = self.spec["model"], self.spec["pre_tokenizer"] or {}
        kinds = [(x["type"], x.get("pattern"), x.get("content")) for x in (self.spec["normalizer"] or {}).get("normalizers", [])]
        steps = pre.get("pretokenizers", [])
        if (
            kinds != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            or [s["type"] for s in steps] != ["Split", "ByteLevel"]
            or steps[0].get("pattern") != {"Regex": PATTERN}
            or (steps[0].get("behavior"), steps[0].get("invert")) != ("Removed", True)
            or steps[1].get("add_prefix_space") or steps[1].get("use_regex")
            or model["type"] != "BPE" or model.get("end_of_word_suffix") != END
            or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in self.spec["added_tokens"])
        ):
            return None
        signs = byte_alphabet()
        back, vocab = {c: b for b, c in enumerate(signs)}, model["vocab"]
        ranks, ids = {}, []

        def put(token: str) -> None:
            ended = token.endswith(END)
            key = bytes(back[c] for c in (token[: -len(END)] if ended else token)) + b"\xff" * ended
            if key not in ranks:
                ranks[key] = len(ids)
                ids.append(vocab[token])

        for c in signs:
            put(c)
        for c in signs:
            put(c + END)
        for m in model["merges"]:
            put("".join(m.split(" ") if isinstance(m, str) else m))
        core = tiktoken.Encoding("merger", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        packed = [i.to_bytes(4, "little") for i in ids]
        merge = core.encode_single_piece
        return lambda word: b"".join([packed[r] for r in merge(word + b"\xff")])

    def _by_library(self, chunk: str) -> bytes:
        import tokenizers

        if self.library is None:
            self.library = tokenizers.Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return b"".join(i.to_bytes(4, "little") for i in self.library.encode(chunk, add_special_tokens=False).ids)

    def encode_chunk(self, chunk: bytes) -> bytes:
        if self.fast is None or any(m in chunk for m in self.marks):
            return self._by_library(chunk.decode())
        if chunk.isascii():
            low = chunk.lower()
            if low.isalpha():
                return self.fast(low)
            if not _PLAIN.fullmatch(low):
                return self._by_library(chunk.decode())
            word = low.rstrip(_SIGNS)
            if word.isalpha():
                return self.fast(word) + self.fast(low[len(word) :])
            return b"".join([self.fast(w) for w in _ASCII.findall(low)])
        text = chunk.decode()
        if not _LATIN.fullmatch(text):
            return self._by_library(text)
        text = text.lower()
        if text.isalpha():
            return self.fast(text.encode())
        return b"".join([self.fast(w.encode()) for w in _SPLIT.findall(text)])

    def encode(self, text: str | None) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit bytes; none for null."""
        data = (text or "").encode("utf-8", "replace")
        if self.fast is None:
            return self._by_library(data.decode())
        get, low = self.chunks.__getitem__, data.lower()  # the normaliser lowers too; bytes.lower() changes A-Z alone
        if any(m in low for m in self.marks):  # these alone mind the case
            low = data
        return b"".join([b"".join(map(get, part.split())) for part in text_slices(low)])


_made: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One per worker process and file."""
    if path not in _made:
        _made[path] = WordBpe(path)
    return _made[path]
