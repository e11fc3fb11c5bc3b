import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lamina.llm import near
from lamina.llm.components import components
from lamina.llm.near import LOSS, STEPS, jaccard_reaches, least_sampled, near_duplicates, shingles

SCHEMA = "doc_id long, text string, node string, n int"


def word_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_force(texts, percent=85):
    sets, up = {i: word_sets(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for own in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        a, b = (sets[i] for i in own)
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(own[0]), root(own[1])))
            up[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in texts}


def outcome(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in texts.items()], SCHEMA).repartition(4)


def prose(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(words, rng, times):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def corpus():
    """Copies, near copies at the border, chains of edits, a passage that many share, and odd texts."""
    rng = random.Random(11)
    out = []
    for _ in range(12):
        base = prose(rng, rng.randint(20, 400))
        out += [base, list(base)] + [edited(base, rng, max(1, int(len(base) * share / 5))) for share in (0.02, 0.05, 0.07, 0.08, 0.09, 0.12)]
    chain = prose(rng, 300)
    for _ in range(15):
        out.append(chain := edited(chain, rng, 3))
    hot = prose(rng, 120)
    out += [edited(hot, rng, rng.randint(0, 3)) for _ in range(60)]
    passage = prose(rng, 60)
    out += [prose(rng, rng.randint(5, 200)) + passage + prose(rng, rng.randint(5, 200)) for _ in range(50)]
    out += [passage + [f"t{i}"] for i in range(8)]
    texts = {i: " ".join(w) for i, w in enumerate(out)}
    order = list(texts)
    rng.shuffle(order)
    texts = {order[i]: t for i, t in texts.items()}
    odd = [None, "", " \t\n", "a", "A", "a b c d", "A  b\nC d", "a b c d e", "a b c d e f", "x" * 300_000, "same words here " * 2000, "same words here " * 3000]
    return texts | {1000 + i: t for i, t in enumerate(odd)}


def test_against_brute_force(spark):
    texts = corpus()
    want = brute_force(texts)
    assert outcome(near_duplicates(frame(spark, texts), percent=85)) == want
    assert len({c for _, c, _ in want.values()}) < len(want) - 60


def test_other_share(spark):
    rng = random.Random(3)
    base = [prose(rng, 100) for _ in range(5)]
    texts = {10 * i + j: " ".join(edited(b, rng, j)) for i, b in enumerate(base) for j in range(5)}
    assert outcome(near_duplicates(frame(spark, texts), percent=80)) == brute_force(texts, 80)
    with pytest.raises(ValueError):
        near_duplicates(frame(spark, texts), percent=50)


@pytest.mark.parametrize("percent,sizes", [(85, [(28, 32), (260, 305), (260, 304), (258, 302)]), (80, [(24, 29), (28, 34), (260, 324)])])
def test_a_sketch_that_just_holds_a_set(spark, percent, sizes):
    """One set fits its sketch, its partner does not: the text and the same with more words at its end."""
    rng, texts = random.Random(17), {}
    for short, long in sizes:
        for _ in range(24):
            words = prose(rng, long, 10**9)
            texts |= {len(texts): " ".join(words[:short]), len(texts) + 1: " ".join(words)}
    want = brute_force(texts, percent)
    assert sum(kept for _, _, kept in want.values()) == len(texts) / 2
    assert outcome(near_duplicates(frame(spark, texts), percent=percent)) == want


@pytest.mark.parametrize("percent", [80, 85])
def test_sets_around_the_size_of_a_sketch(spark, percent):
    """Added, cut and scattered words at random sizes on both sides of either sketch's size."""
    rng, texts = random.Random(percent), {}
    for low, high in ((20, 40), (230, 420)):
        for _ in range(60):
            words = prose(rng, rng.randint(low, high), 10**9)
            n = len(words) - 4
            more = rng.randint(0, max(1, int(n * (100 / percent - 1))))
            part = rng.randint(0, more)
            for other in (words, words + prose(rng, more, 10**9), prose(rng, part, 10**9) + words + prose(rng, more - part, 10**9), words[: max(1, len(words) - more)], edited(words, rng, max(1, more // 6))):
                texts[len(texts)] = " ".join(other)
    assert outcome(near_duplicates(frame(spark, texts), percent=percent)) == brute_force(texts, percent)


def test_a_family_beyond_one_round(spark, monkeypatch):
    """Lists with more outliers than a round compares: several rounds, and no link lost."""
    monkeypatch.setattr(near, "FIRST_OUTLIERS", 2)
    monkeypatch.setattr(near, "MORE_OUTLIERS", 2)
    rng, texts = random.Random(23), {}
    base = prose(rng, 200)
    for _ in range(40):
        other = edited(base, rng, rng.randint(7, 14))
        for words in (other, edited(other, rng, 1)):
            texts[len(texts)] = " ".join(words)
    want = brute_force(texts, 85)
    assert 20 < len({c for _, c, _ in want.values()}) < 60
    assert outcome(near_duplicates(frame(spark, texts), percent=85)) == want


def test_bounds_are_exact_tails():
    for k in (24, 256):
        for percent in (80, 85):
            whole = least_sampled(percent, k)
            assert whole <= min(least_sampled(percent, k, n) for n in (k + 1, 2 * k, 20 * k)) and least_sampled(percent, k, k) == -(-percent * k // 100)
            tail = sum(math.comb(k, i) * percent**i * (100 - percent) ** (k - i) for i in range(whole)) / 100**k
            assert tail <= LOSS < tail + math.comb(k, whole) * percent**whole * (100 - percent) ** (k - whole) / 100**k
    # The steps allow for every smaller union.
    for k, percent in ((24, 80), (24, 85), (256, 80), (256, 85)):
        for step in STEPS:
            most, even = int(step * k), 100 // math.gcd(percent, 100)
            least = least_sampled(percent, k, -(-most * 100 // (percent * even)) * even)
            assert all(least <= least_sampled(percent, k, n) for n in range(k + 1, most * 100 // percent + 1, 1 if k < 100 else 7))


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(prose(random.Random(5), 3000, 500)) + " " + "y" * 1000 + " end of it all"
    want = shingles(text)
    for block in (64, 500):
        monkeypatch.setattr(near, "BLOCK", block)
        assert np.array_equal(shingles(text), want)


def test_texts_that_share_an_id(spark):
    """Each row counts with its own text; a component has the smallest id of its rows."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (3, a + " more"), (9, b + " more"), (9, c), (None, c)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 5, True), (3, 3, True), (9, 5, False), (9, 9, True), (None, 9, False)], key=str)


def test_rows(spark):
    df = spark.createDataFrame([(None, "p q r s t u"), (5, "p q r s t u"), (5, "p q r s t u"), (7, None), (None, None), (None, "only here")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (7, 0, 7, True), (None, 0, None, True), (None, 1, None, True)], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


def test_shingles():
    for t in ("", "a", "a b c d e a b c d e", "É é A a  b\tc\x0bd e f", "x " * 5000):
        assert len(shingles(t)) == len(word_sets(t))
    a, b = shingles("a b c d e f g"), shingles("a b c d e f h")
    assert len(np.intersect1d(a, b)) == 2 and not jaccard_reaches(a, b, 85) and jaccard_reaches(a, a, 100) and not jaccard_reaches(a[:0], a[:0], 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101 + i) for i in range(50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    rng.shuffle(edges)
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up if any(i in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
