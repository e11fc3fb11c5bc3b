"""Near-duplicate classes by bottom-k sketches of word shingles, with exact verification.

A text's sketch is its smallest shingle hashes, all from one hash function. Short sketches of all texts find those that
share enough values with others; these get long sketches, which hold the whole set of a shorter text. The k smallest
values of a union are a sample of it, so similar sets share a certain number of them but for a chance of LOSS (both
whole: for certain). Of the values, ordered by rarity, a prefix therefore cannot miss the other set: only prefixes enter
the inverted lists, with each value's place, which bounds what two sets can share beyond it.

A list is not expanded into pairs. Its most central member, the hub, is compared with all others; where the members then
lie in several components, the outliers (those outside the largest one) are compared with the rest, up to FIRST_OUTLIERS
of a list in a round and more of them in each further one. Pairs pass the bounds on sizes and places and the
union-sketch estimate; the full sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .shared import Sink, bounded, discard, rows, stored, text_slices

WORDS = 5
#: Values of short and long sketches.
SKETCH, LONG_SKETCH = 24, 256
#: Most that the chance to miss a link may be in each of the two kinds of sketches: an exact tail probability.
LOSS = 1e-6
#: Set sizes, as multiples of a sketch's, up to which the tail is that of a union so large; beyond, of an endless one.
STEPS = (1.25, 1.5, 2, 3, 4, 8)
#: Outliers of a list that the first round compares; MORE_OUTLIERS times as many in each later one.
FIRST_OUTLIERS, MORE_OUTLIERS = 256, 8

SKETCHES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int64()))])
#: Bytes that are hashed at once.
BLOCK = 1 << 16
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(WORDS)]


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(int(_P)), _powers(pow(int(_P), -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: equal stays equal, and near values spread evenly."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _summed(data: bytes) -> np.ndarray:
    """Running sums of a polynomial over at most BLOCK bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def _of_words(parts: list[bytes]) -> np.ndarray:
    """A hash of each word, the same wherever the word lies."""
    whole = b" ".join(parts)
    if len(whole) > BLOCK:
        if len(parts) > 1:
            half = len(parts) // 2
            return np.concatenate([_of_words(parts[:half]), _of_words(parts[half:])])
        h = 0
        for at in range(0, len(whole), BLOCK):
            h += int(_summed(whole[at : at + BLOCK])[-1]) * pow(int(_P), at, 1 << 64)
        return np.array([h % (1 << 64)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    sums = _summed(whole)
    return (sums[starts + lengths] - sums[starts]) * _DOWN[starts]


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a whole text, ascending, as unsigned 64-bit integers; a block of it at a time.

    A-Z in lower case; words lie between runs of 0x20 and 0x09 to 0x0D; fewer words than a shingle holds are one.
    """
    found = [_of_words(p) for s in text_slices((text or "").encode("utf-8", "replace").lower(), BLOCK) if (p := s.split())]
    if not found:
        return np.zeros(0, np.uint64)
    h = _mixed(np.concatenate(found))
    words = min(WORDS, len(h))
    out = np.full(len(h) - words + 1, words, np.uint64)
    for i in range(words):
        out += h[i : i + len(out)] * _Q[i]
    return np.unique(_mixed(out))


def jaccard_reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays; empty sets reach nothing."""
    if not len(a) or not len(b):
        return False
    same = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * same >= percent * (len(a) + len(b) - same)


@cache
def least_sampled(percent: int, k: int, union: int | None = None) -> int:
    """The most that a sample of k of a union's values, percent of which are common, holds of these but for a chance of
    LOSS: the exact tail, hypergeometric or, for an endless union, binomial."""
    if union is not None and union <= k:
        return -(-percent * union // 100)
    common = None if union is None else -(-percent * union // 100)

    def log_choose(n: int, m: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1)

    tail = 0.0
    for m in range(k + 1):
        if union is None:
            log = log_choose(k, m) + m * math.log(percent / 100) + (k - m) * math.log1p(-percent / 100) if percent < 100 else -math.inf
        elif m > common or k - m > union - common:
            log = -math.inf
        else:
            log = log_choose(common, m) + log_choose(union - common, k - m) - log_choose(union, k)
        tail += math.exp(log)
        if tail > LOSS:
            return m
    return k


def _sampled(n: Column, percent: int, k: int) -> Column:
    """least_sampled for a set of n shingles and any similar one: their union has at most n * 100 / percent values."""
    out, even = F.lit(least_sampled(percent, k)), 100 // math.gcd(percent, 100)
    for step in reversed(STEPS):  # a union of which the least share is a whole number: no smaller one allows for less
        most = int(step * k)
        out = F.when(n <= most, least_sampled(percent, k, -(-most * 100 // (percent * even)) * even)).otherwise(out)
    return out


def least_common(percent: int, k: int) -> Column:
    """The least number of values that the sketches of k values of a set of n shingles and of any similar set share.

    A similar set has up to n * 100 / percent shingles. Only if a sketch holds that many are both sets whole, and the
    count exact; else the partner's sketch may be cut, and the k smallest values of the union, which both sketches hold
    as far as the sets share them, are a sample.
    """
    n = F.col("n")
    whole, cut = F.ceil(n * percent / 100), _sampled(n, percent, k)
    return F.when(F.floor(n * 100 / percent) <= k, whole).when(n <= k, F.least(whole, cut)).otherwise(cut)


def sketches(texts: DataFrame, k: int) -> DataFrame:
    """(doc_id, text) to doc_id, n (set size), digest of the whole set (null if empty) and its k smallest values, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(SKETCHES)
        for key, text in rows(batches, 64):
            s = shingles(text)
            digest = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
            # Flipping the sign bit makes the signed order agree with the unsigned one.
            if sink.add(key, len(s), digest, (s[:k] ^ np.uint64(1 << 63)).view(np.int64), size=8 * k):
                yield sink.batch()
        if sink.n:
            yield sink.batch()

    return bounded(texts).mapInArrow(run, "doc_id long, n long, digest binary, sketch array<long>")


def prefixes(nodes: DataFrame, least: Column, what: str) -> DataFrame:
    """(node, n, size, alone, central, all): a set's shared values, rarest first, as far as a similar set must hold one of them.

    least is the number of values that a similar set must share with (n, size). A set's values that no other holds,
    alone of them, come first and only count for the places of the rest. central, the sum of all frequencies, is highest
    for a set whose values many share.
    """
    values = nodes.select("node", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("v"))
    shared = stored(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), f"{what}-values")
    found = values.join(shared, "v").groupBy("node", "n", "size").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("found"), F.sum("df").alias("central"))
    room = (F.size("found") - least + 1).cast("int")
    alone = (F.col("size") - F.size("found")).alias("alone")
    out = stored(found.where(room > 0).select("node", "n", "size", alone, "central", F.slice("found.v", 1, room).alias("all")), what)
    discard(shared)
    return out


def inverted_lists(prefix: DataFrame) -> DataFrame:
    """(v, node, n, size, place, i, central): the sets of each value, its place among a set's values and in the prefix."""
    values = prefix.select("node", "n", "size", "alone", "central", F.posexplode("all").alias("i", "v"))
    return values.select("v", "node", "n", "size", (F.col("alone") + F.col("i") + 1).alias("place"), "i", "central")


def _can_be_similar(percent: int) -> Column:
    """For (n, size, place) and (n2, size2, place2) of two sets at their first common value: whether sizes and what can
    follow leave enough in common."""
    whole = (F.col("n") <= LONG_SKETCH) & (F.col("n2") <= LONG_SKETCH)
    exact = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent))
    sampled = F.least(exact, _sampled(F.least("n", "n2"), percent, LONG_SKETCH))
    reach = F.least(F.col("size") - F.col("place"), F.col("size2") - F.col("place2")) + 1
    return (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent) & (reach >= F.when(whole, exact).otherwise(sampled))


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, sure) whose union's sketch holds enough common values; sure where both sets are whole, and compared so."""
    sides = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    common = F.array_intersect("sa", "sb")
    exact = F.size(common) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, LONG_SKETCH)
    met = F.size(F.array_intersect(common, union))
    whole = (F.col("na") <= LONG_SKETCH) & (F.col("nb") <= LONG_SKETCH)
    least = F.least(F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent)), _sampled(F.least("na", "nb"), percent, LONG_SKETCH))
    return both.where(F.when(whole, exact).otherwise(met >= least)).select("a", "b", whole.alias("sure"))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough. The text of b, the more central one, comes last, so a task that holds
    many pairs of one hub makes its set once."""
    first = pairs.where("NOT sure").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, last, held = Sink(out), None, None
        for a, b, ta, tb in rows(batches, 16):
            if held is None or b != last:
                last, held = b, shingles(tb)
            if jaccard_reaches(shingles(ta), held, percent) and sink.add(a, b):
                yield sink.batch()
        if sink.n:
            yield sink.batch()

    return pairs.where("sure").select("a", "b").union(bounded(both.select("a", "b", "ta", "tb")).mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs.

    Documents whose sets of WORDS-word shingles have 100 * intersection >= percent * union are linked; component_id is
    the smallest doc_id that links reach, kept says that this is the document's own. percent must be 80 or more.

    Equal sets are one node, so copies cost no pairs. Hot values never meet in one task: lists are aggregated on the map
    side, their joins can be split, and a list of n members compares one hub, then outliers, with the others.

    Defined cases: a null, empty or blank text has no shingles and is linked with nothing; a null doc_id takes the
    component of its set but can name none, and is kept only if no id can; where rows of different texts share a doc_id,
    each row counts with its own text, and a component is named by the smallest id of its rows; an empty table gives no
    rows; other columns are ignored; long texts are hashed whole, a block at a time.
    """
    if percent < 80:
        raise ValueError("the sketch is laid out for similarities of 0.8 and more")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    known = stored(sketches(texts, SKETCH), "sketches")
    texts_of = known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("other"))
    if not texts_of.where("one <> other").isEmpty():
        return _by_row(texts, percent)
    made = known.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(made, "classes")
    nodes = classes.where("node IS NOT NULL").select("node", "n", "sketch")

    # Short sketches tell which sets can have partners at all; from here on only these count.
    prefix = prefixes(nodes, least_common(percent, SKETCH), "short-prefixes")
    met = inverted_lists(prefix).groupBy("v").agg(F.count("*").alias("m")).where("m > 1").select("v")
    wanted = stored(inverted_lists(prefix).join(stored(met, "met"), "v", "left_semi").select("node").distinct(), "wanted", prefix.count())
    discard(prefix)
    texts = stored(texts.withColumnRenamed("doc_id", "node").join(wanted, "node", "left_semi"), "texts")
    nodes = stored(sketches(texts.withColumnRenamed("node", "doc_id"), LONG_SKETCH).where("n > 0").select(F.col("doc_id").alias("node"), "n", "sketch"), "long-sketches")

    prefix = prefixes(nodes, least_common(percent, LONG_SKETCH), "prefixes")
    listed = inverted_lists(prefix)
    second = [F.col(c).alias(f"{c}2") for c in ("n", "size", "place")]
    hubs = listed.groupBy("v").agg(F.max(F.struct("central", F.col("node").alias("b"), *second)).alias("hub"), F.count("*").alias("m"))
    hubs = stored(hubs.where("m > 1").select("v", "m", *(f"hub.{c}" for c in ("b", "n2", "size2", "place2"))), "hubs")
    lists = stored(listed.withColumnRenamed("node", "a").drop("central").join(hubs, "v").where("a <> b"), "lists")

    def evaluated(met: DataFrame, tried: DataFrame | None) -> DataFrame:
        """The distinct pairs (a, b, sure) of rows that met in a list and are worth verifying."""
        fresh = met.select("a", "b").distinct()
        if tried is not None:
            fresh = fresh.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        return stored(_estimated(fresh, nodes, percent), "pairs")

    similar = _can_be_similar(percent)
    pairs = evaluated(lists.where(similar), None)
    links = stored(_verified(pairs, texts, percent), "links")
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found, most = components(links), FIRST_OUTLIERS
    # The hub has met every member of its list where the two share no earlier value, so lists of two are done, and from here
    # on lists are without their hubs.
    wide = lists.where("m > 2").select("v", "a", "n", "size", "place", "i", F.lit(False).alias("asked"))
    hub_of = hubs.where("m > 2").select("v", F.col("b").alias("a"))
    while True:
        named = found.withColumnsRenamed({"node": "a", "component": "own"})
        own = stored(wide.join(named, "a", "left").withColumn("own", F.coalesce("own", "a")), "labelled")
        central = hub_of.join(named, "a", "left").select("v", F.coalesce("own", "a").alias("own"), F.lit(1).alias("m"), F.lit(0).alias("left"))
        parts = own.groupBy("v", "own").agg(F.count("*").alias("m"), F.sum((~F.col("asked")).cast("int")).alias("left"))
        parts = parts.union(central).groupBy("v", "own").agg(F.sum("m").alias("m"), F.sum("left").alias("left"))
        sizes = parts.groupBy("v").agg(F.max(F.struct("m", "own", "left")).alias("main"), F.sum("left").alias("left"))
        split = stored(sizes.select("v", F.col("main.own").alias("main"), (F.col("left") - F.col("main.left")).alias("outliers")).where("outliers > 0"), "open-lists")
        own = own.join(split, "v").join(prefix.select(F.col("node").alias("a"), "all"), "a")
        own = stored(own.withColumn("before", F.slice("all", F.lit(1), F.col("i"))).drop("all"), "open")
        apart = own.where("own <> main AND NOT asked")
        every = apart.where(F.col("outliers") <= most)
        slots = W.partitionBy("v", F.pmod(F.xxhash64("a"), F.lit(most))).orderBy("a")
        some = apart.where(F.col("outliers") > most).withColumn("nth", F.row_number().over(slots)).where("nth = 1").drop("nth")
        chosen = stored(every.union(some).select("v", F.col("a").alias("b"), *second, F.col("before").alias("before2"), F.col("own").alias("own2")), "outliers")
        if chosen.isEmpty():
            break
        # Two sets meet in the list of their first common value alone, and two outliers of a list in one order.
        first = ~F.arrays_overlap("before", "before2")
        twice = (F.col("outliers") <= most) & (F.col("own") != F.col("main")) & ~F.col("asked") & (F.col("a") > F.col("b"))
        pairs = evaluated(own.join(chosen, "v").where((F.col("a") != F.col("b")) & ~F.col("asked") & ~twice & similar & (F.col("own") != F.col("own2")) & first), tried)
        tried = tried.union(pairs.select("a", "b"))
        if not pairs.isEmpty():
            more = stored(_verified(pairs, texts, percent), "links")
            if not more.isEmpty():
                found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        # Lists whose outliers have all been compared, and those in one piece, need no further look.
        asked = chosen.select("v", F.col("b").alias("a"), F.lit(True).alias("now"))
        rest = own.where(F.col("outliers") > most).join(asked, ["v", "a"], "left")
        wide = stored(rest.select("v", "a", "n", "size", "place", "i", (F.col("asked") | F.coalesce("now", F.lit(False))).alias("asked")), "wide")
        hub_of = stored(hub_of.join(split.where(F.col("outliers") > most).select("v"), "v", "left_semi"), "hubs")
        discard(own, chosen, split)
        if wide.isEmpty():
            break
        most *= MORE_OUTLIERS
    return _result(known, classes, found)


def _by_row(texts: DataFrame, percent: int) -> DataFrame:
    numbered = stored(texts.withColumn("row", F.monotonically_increasing_id()), "numbered")
    of_rows = near_duplicates(numbered, percent=percent, id_col="row").withColumnsRenamed({"doc_id": "row", "component_id": "own"}).drop("kept")
    found = stored(numbered.select("row", "doc_id").join(of_rows, "row"), "by-row")
    named = found.groupBy("own").agg(F.min("doc_id").alias("component_id"))
    kept = F.when(F.col("doc_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("doc_id") == F.col("component_id"))
    return found.join(named, "own").select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _result(known: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    named = stored(classes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id")), "named")
    out = known.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.when(F.col("doc_id").isNull(), component.isNull()).otherwise(F.col("doc_id") == component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
