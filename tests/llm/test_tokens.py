"""Tokenizers, token counts, pieces and packing against the libraries and brute force."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from lamina.llm.packing import Bm25Shard, pack
from lamina.llm.pieces import CharMap, decode_documents, encode_documents, piece_encoder, round_trips
from lamina.llm.shared import text_slices
from lamina.llm.token_counts import count_tokens
from lamina.llm.wordbpe import WordBpe, word_bpe

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = "aeiß ÉÀé'stre\t\n\x0b\x1c\x85\xa0 Σσ İ ŉ<s></s>123½²,.;—日本́é🙂A▁▁   the and"
TEXTS = [None, "", " ", "a", "The cat's <|endoftext|> mat.", "x\ny  z", "Straße <|startoftext|>", "word " * 3000, "▁ a▁b", "\n\n", "日本語 🙂 ok", "q" * 5000, "same", "same"]
SCHEMA = "doc_id long, text string, ids string, digest int"


def docs(spark, texts=TEXTS, first=0):
    return spark.createDataFrame([(None if i == 1 else first + i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA)


def random_texts(n):
    rng = random.Random(n)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", "<|endoftext|>b"]) for _ in range(n)]


def word_ids(text):
    return tokenizers.Tokenizer.from_file(WORD).encode(text or "", add_special_tokens=False).ids


def test_word_bpe_equals_the_library():
    library, own = tokenizers.Tokenizer.from_file(WORD), word_bpe(WORD)
    assert own.fast
    for t in [t for t in TEXTS if t] + random_texts(1500):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_other_files_use_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = tokenizers.Tokenizer.from_file(path), WordBpe(path)
    assert own.fast is None
    for t in random_texts(50):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_cache_bound():
    own = WordBpe(WORD, cache=10)
    text = " ".join(f"w{i}" for i in range(100))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == word_ids(text) and len(own.chunks) <= 10


def test_slices_join_to_the_text():
    data = b"ab cd\tefghijklmnop q " * 50
    for limit in (1, 7, 64, 10_000):
        assert b"".join(text_slices(data, limit)) == data


@pytest.mark.parametrize("tokenizer", [WORD, PIECE])
def test_counts(spark, tmp_path, tokenizer):
    cache, library = f"file://{tmp_path}/cache", sentencepiece.SentencePieceProcessor(model_file=PIECE)
    count = (lambda t: len(word_ids(t))) if tokenizer == WORD else lambda t: len(library.encode(t or ""))
    for first in (0, 100):  # the second batch finds everything in the cache
        got = count_tokens(docs(spark, first=first), tokenizer, cache=cache).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((None if i == 1 else first + i, len((t or "").encode()), count(t), count(t) > 2048) for i, t in enumerate(TEXTS))
    stored = spark.read.parquet(f"{cache}/*")
    assert stored.count() == stored.select("digest").distinct().count() <= len(set(TEXTS))
    more = count_tokens(docs(spark, ["brand new", "same"]), tokenizer, cache=cache)
    assert more.count() == 2 and spark.read.parquet(f"{cache}/*").count() == stored.count() + 1
    assert count_tokens(docs(spark, []), tokenizer).collect() == []


def test_pieces_equal_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), piece_encoder(PIECE)
    for t in TEXTS + random_texts(2000):
        ids, at = own.encode(t)
        assert ids.tolist() == library.encode(t or "") and own.decode(ids.tolist()) == library.decode(ids.tolist())
        assert at[0] == 0 and at[-1] == len((t or "").encode()) and (np.diff(at) >= 0).all()
    rng = random.Random(3)
    for _ in range(500):
        ids = [rng.randrange(rng.choice([300, 32000])) for _ in range(6)]
        assert own.decode(ids) == library.decode(ids)


def test_spans_are_the_pieces(spark):
    own = piece_encoder(PIECE)
    for r in encode_documents(docs(spark), PIECE).collect():
        text = next(t for i, t in enumerate(TEXTS) if (None if i == 1 else i) == r.doc_id) or ""
        data = text.encode()
        assert b"".join(data[a:b] for a, b in zip(r.starts, r.ends, strict=True)) == data
        for i, a, b in zip(r.ids, r.starts, r.ends, strict=True):
            assert data[a:b].decode("utf-8", "replace").replace("▁", " ") in (own.pieces[i].replace("▁", " "), own.pieces[i].replace("▁", " ")[1:]) or own.is_byte[i]


def test_normalize_aligns():
    own = piece_encoder(PIECE)
    normal, align = own.normalize("a é b".encode())
    assert normal.decode() == "▁a▁é▁b" and align.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 3, 4, 4, 4, 5, 6]


def double_array(entries):
    """A compiled character map of {prefix: replacement}, by the plainest placement."""
    children, values, blob = defaultdict(dict), {}, b""
    for key, replacement in entries.items():
        node = ()
        for b in key:
            children[node].setdefault(b, (*node, b))
            node = (*node, b)
        values[node], blob = len(blob), blob + replacement + b"\0"
    units, base = {0: 0}, 256
    places = {(): 0}
    for node in sorted({n for n in places} | {c for k in children.values() for c in k.values()}, key=len):
        at = places[node]
        offset = at ^ base
        assert offset < 1 << 21
        units[at] = units.get(at, 0) | offset << 10 | (256 if node in values else 0)
        if node in values:
            units[base] = 1 << 31 | values[node]
        for b, child in children[node].items():
            places[child] = base ^ b
            units[base ^ b] = b
        base += 256
    trie = struct.pack(f"<{base}I", *(units.get(i, 0) for i in range(base)))
    return struct.pack("<I", len(trie)) + trie + blob


def test_character_map():
    entries = {"é".encode(): b"e", b"ab": b"X", b"abc": b"YY", b"\t": b" ", b"z": b""}
    found = CharMap(double_array(entries))
    assert found.longest(b"abcd", 0) == (3, b"YY") and found.longest(b"abd", 0) == (2, b"X") and found.longest(b"ad", 0) is None
    assert found.longest("xé".encode(), 1) == (2, b"e") and found.longest(b"", 0) is None
    own = piece_encoder(PIECE)
    kept, own.map, own.squeeze = (own.map, own.squeeze), found, True
    try:
        normal, align = own.normalize(" \tabcé  zq\t".encode())
        assert normal.decode() == "▁YYe▁q" and align.tolist() == [2, 2, 2, 2, 2, 5, 7, 7, 7, 10, 11]
    finally:
        own.map, own.squeeze = kept


def test_round_trips(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r.doc_id: r for r in round_trips(docs(spark), PIECE).collect()}
    for i, t in enumerate(TEXTS):
        ids, r = library.encode(t or ""), got[None if i == 1 else i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest() and r.n_source_bytes == len((t or "").encode())
    texts = {r.doc_id: r.text for r in decode_documents(encode_documents(docs(spark), PIECE), PIECE).collect()}
    assert texts[4] == "The cat's <|endoftext|> mat." and texts[0] == ""
    assert round_trips(docs(spark, []), PIECE).collect() == []


def check_packing(rows, texts, window=2048):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for key, own in pieces.items():
        ids, at = np.array([*word_ids(texts[key]), 1], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            if "ids" in r:
                assert r.ids == ids[at : at + r.length].tolist()
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == window or at < window and at & (at - 1) == 0
    return sequences


def test_packing(spark):
    rng = random.Random(1)
    texts = dict(enumerate([t for t in TEXTS if t != ""] + [" ".join(rng.choice(["red", "blue", "sky", "sea", "oak"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for shard in (1_000, 2_000_000):
        check_packing(pack(df, WORD, with_ids=True, shard_tokens=shard).collect(), texts)
    full = check_packing(pack(df.coalesce(1), WORD).collect(), texts)
    assert sum(sum(r.length for r in s) < 2048 for s in full.values()) <= 11
    assert pack(df.limit(0), WORD).collect() == []
    twice = pack(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string"), WORD).collect()
    total = Counter()
    for r in twice:
        total[r.doc_id] += r.length
    assert total == {None: 6, 1: 1}


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(5)
    data = [rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint32) for _ in range(200)]
    index = Bm25Shard(data)
    n, mean = len(data), np.mean([len(d) for d in data])
    df = Counter(t for d in data for t in set(d.tolist()))

    def score(seed, doc):
        own = Counter(data[doc].tolist())
        idf = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) for t in own}
        return sum(idf[t] * own[t] * 2.2 / (own[t] + 1.2 * (0.25 + 0.75 * len(data[doc]) / mean)) for t in set(data[seed].tolist()) if t in own and df[t] > 1)

    for seed in range(0, 200, 17):
        index.unused[:] = True
        index.unused[[seed, 3, 4]] = False
        want = sorted((d for d in range(n) if index.unused[d] and score(seed, d) > 0), key=lambda d: (-round(score(seed, d), 9), d))[:16]
        got = index.neighbours(seed)
        assert [round(score(seed, d), 6) for d in got] == [round(score(seed, d), 6) for d in want]


def test_windows_hold_neighbours(spark):
    """Documents about one thing, dealt in turn, meet in the same windows."""
    topics = [["red", "rose", "leaf"], ["steel", "bolt", "gear"], ["wave", "tide", "boat"]]
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(topics[i % 3]) for _ in range(250)) for i in range(90)}
    rows = pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1), WORD).collect()
    by = defaultdict(Counter)
    for r in rows:
        by[r.sequence_id][r.doc_id % 3] += r.length
    assert np.mean([max(c.values()) / sum(c.values()) for c in by.values()]) > 0.8


def test_a_seed_fills_its_window(spark):
    """Short documents about one thing, far more than one request returns, meet in whole windows."""
    topics = [["red", "rose", "leaf"], ["steel", "bolt", "gear"], ["wave", "tide", "boat"]]
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(topics[i % 3]) for _ in range(19)) for i in range(1500)}
    by = defaultdict(Counter)
    for r in pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1), WORD).collect():
        by[r.sequence_id][r.doc_id % 3] += r.length
    assert np.mean([max(c.values()) / sum(c.values()) > 0.99 for c in by.values()]) > 0.5


def test_all_terms_of_a_seed_ask():
    seed = np.repeat(np.arange(30, dtype=np.uint32), 2)
    docs = [seed, *(np.array([t, 100 + t], np.uint32) for t in range(30))]
    assert np.count_nonzero(Bm25Shard(docs).scores(0)[1:]) == 30


def test_a_digest_that_was_added_twice_counts_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words"), (2, "others"), (3, "some words")], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    first = sorted(count_tokens(df, path, cache=str(tmp_path)).collect())
    for folder in tmp_path.iterdir():  # another writer adds the same digests
        held = spark.read.parquet(str(folder)).collect()
        spark.createDataFrame(held, "digest binary, n_tokens long").write.mode("append").parquet(str(folder))
    more = df.union(spark.createDataFrame([(4, "a new text")], df.schema))
    got = sorted(count_tokens(more, path, cache=str(tmp_path)).collect())
    assert got[:3] == first and len(got) == 4
