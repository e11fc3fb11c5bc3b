"""Main text of web pages by equivalence-class template deduction.

A template is fitted once for each host, on all its distinct pages, and applied to all its pages wherever they are. Tokens
(tags and text runs, each with the path of the elements around it) that share their occurrence vector over the distinct
pages form classes. `deduce` and `region` say what that means for pages in memory; `templates` finds the same for tables,
and never brings a host's pages together. A class whose tokens keep one
order on every page, and which lies within one gap of the class that holds it, belongs to the template; what remains
between its tokens are slots. The region is the template's element whose slots hold most of the text that varies from
page to page; what lies outside it goes, and so does template text inside. Names of elements and classes break ties:
slots below boilerplate elements go, and of a region that is wider than an article only this stays. Template text in an
article must lie in most articles of different text. Pages of hosts without a region are told by names alone.
"""

from __future__ import annotations

import html as references
import re
import struct
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Sink, bounded, discard, rows, stored

#: Entries that a task gathers before it gives them out as part sums, and hosts whose templates it keeps unpacked.
HELD, HOSTS = 100_000, 256
#: Fewest pages, share of the host's pages and tokens of a template class.
MIN_PAGES, MIN_SHARE, MIN_TOKENS = 5, 0.8, 3
#: Share of the varying text that a region holds, and what more an outer element may hold for its part to belong to it.
LEAST_SHARE, MORE_SHARE = 0.5, 0.1

#: Elements whose text is markup or code; end tags that are left out; elements that break a block of text.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes", "svg", "math"}
HIDDEN = {"head", "select", "option", "button", "datalist", "object", "audio", "video", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
LEAVES = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot"}
MAIN = {"article", "main"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words of class and id names that mark boilerplate, and those that do so outside an article only.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "gdpr", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promotion", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
MARKS_OUTSIDE = {"header", "footer", "masthead", "copyright", "legal", "bottom", "topbar"}
#: Classes of an article element that is none.
TEASERS = {"ad", "advert", "advertisement", "comment", "promo", "related", "reply", "sponsored"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden|itemprop)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_CLASS = re.compile(r"\bclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}

#: Kinds of a text run, by the elements around it.
OUT, BODY, IN_MAIN = 0, 1, 2


def _zone(name: str, attributes: str, kind: int) -> int:
    """Of an element, inside one of the given kind."""
    if kind == OUT or name in HIDDEN or name in RAW:
        return OUT
    if name in BOILERPLATE and not (name == "header" and kind == IN_MAIN):
        return OUT
    if attributes.strip():
        words: set[str] = set()
        classes: set[str] = set()
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return OUT
            if key == "role" and value.lower() in ROLES:
                return OUT
            if key == "role" and value.lower() in ("main", "article") or key == "itemprop" and value.lower() == "articlebody":
                kind = IN_MAIN
            if key in ("class", "id"):
                words |= {w.lower() for w in _NAMES.findall(value)}
                classes |= set(value.lower().split())
        if name in MAIN and classes & TEASERS:
            return OUT
        if name not in ("html", "body", *MAIN) and (words & MARKS or kind != IN_MAIN and words & MARKS_OUTSIDE):
            return OUT
    return IN_MAIN if name in MAIN else kind


def _label(attributes: str) -> str:
    """The class names without digits, which tell elements of a template apart."""
    m = _CLASS.search(attributes) if attributes else None
    return "".join(f".{c}" for c in sorted({c.lower() for c in m[1].strip("\"'").split()}) if c.replace("-", "").replace("_", "").isalpha()) if m else ""


def parse(page: str) -> list[tuple]:
    """Tokens of a page in order: ("<", path) for a tag that breaks text, ("", text, kind, path) for a run of text.

    Inline tags join the runs around them; character references are decoded; white space becomes one space. Missing,
    crossed and truncated tags are taken as they come.
    """
    out: list[tuple] = []
    stack: list[tuple[str, int, str]] = [("", BODY, "")]
    text: list[str] = []

    def flush() -> None:
        run = " ".join("".join(text).split())
        text.clear()
        if run:
            out.append(("", run, stack[-1][1], stack[-1][2]))

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            rest = page[at:]
            text.append(references.unescape(rest if not re.match(r"</?[a-zA-Z]", rest) else ""))
            break
        if m.start() > at:
            text.append(references.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in RAW and not m[1] and not m[3].endswith("/"):
            close = _ENDS[name].search(page, at)
            at = close.end() if close else end
            if name not in ("svg", "math"):
                continue
            text.append(" ")
            continue
        if name in INLINE:
            if not m[1] and stack[-1][0] == name:
                stack.append(stack[-1])
            elif not m[1] and name not in VOID and m[3].strip():
                kind = _zone(name, m[3], stack[-1][1])
                if kind != stack[-1][1]:  # an inline element that is boilerplate or hidden: its own run
                    flush()
                    stack.append((name, kind, f"{stack[-1][2]}/{name}"))
                    out.append(("<", stack[-1][2]))
            elif m[1] and stack[-1][0] == name:
                flush()
                stack.pop()
            continue
        flush()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
            out.append((">", f"{stack[-1][2]}/{name}"))
            continue
        if stack[-1][0] in LEAVES and (stack[-1][0] == "p" or stack[-1][0] == name):  # its end tag was left out
            stack.pop()
        path = f"{stack[-1][2]}/{name}{_label(m[3])}"
        out.append(("<", path))
        if name not in VOID and name not in LEAVES and not m[3].endswith("/"):
            stack.append((name, _zone(name, m[3], stack[-1][1]), path))
        elif _zone(name, m[3], stack[-1][1]) == OUT != stack[-1][1] and name not in VOID:
            stack.append((name, OUT, path))
    flush()
    return out


def _ordered(pages: list[list], members: set) -> bool:
    """Whether the class's tokens keep one order, over and over, on every page that holds them."""
    order = None
    for tokens in pages:
        seen = [t for t in tokens if t in members]
        if not seen:
            continue
        order = order or seen[: len(members)]
        if len(seen) % len(order) or any(seen[i : i + len(order)] != order for i in range(0, len(seen), len(order))):
            return False
    return order is not None and len(order) == len(members)


def deduce(pages: list[list[tuple]]) -> set[tuple]:
    """The template tokens of distinct pages of one host: nested valid classes of equal occurrence vectors.

    For pages in memory; `templates` gives the same for a table.
    """
    n = len(pages)
    if n < MIN_PAGES:
        return set()
    keyed = [[_key(t) for t in p] for p in pages]
    vectors: dict[tuple, dict[int, int]] = {}
    for i, tokens in enumerate(keyed):
        for t in tokens:
            v = vectors.setdefault(t, {})
            v[i] = v.get(i, 0) + 1
    classes: dict[tuple, list[tuple]] = {}
    for t, v in vectors.items():
        if len(v) >= max(MIN_PAGES, MIN_SHARE * n):
            classes.setdefault(tuple(sorted(v.items())), []).append(t)
    template: set[tuple] = set()
    # The class that occurs on most pages, once on each, is the outermost; later ones must lie within one of its gaps.
    for _, members in sorted(classes.items(), key=lambda c: (-len(c[0]), sum(k for _, k in c[0]), -len(c[1]), min(map(_digest, c[1])))):
        group = set(members)
        if len(group) < MIN_TOKENS or not _ordered(keyed, group):
            continue
        if template and any(len(_gaps(tokens, template, group)) > 1 for tokens in keyed):
            continue
        template |= group
    return template - _of_copies(pages)


def _gaps(tokens: list[tuple], template: set[tuple], group: set[tuple]) -> set[tuple | None]:
    """Between which template tokens the group's tokens lie; a gap that repeats counts once."""
    last, out = None, set()
    for t in tokens:
        if t in template:
            last = t
        elif t in group:
            out.add(last)
    return out


def _key(token: tuple) -> tuple:
    """What the runs of one text at one place share; a tag is its own key."""
    return token if token[0] else (token[0], token[1], token[3])


def _digest(key: tuple) -> bytes:
    return xxhash.xxh3_128_digest((f"{key[0]}{key[1]}" if key[0] else f"{key[2]}\n{key[1]}").encode())


def _of_copies(pages: list[list[tuple]]) -> set[tuple]:
    """Runs in articles that too few different articles hold: pages that copy an article share it, yet it is no template.
    Articles of equal text count once."""
    articles = {tuple(t[1] for t in p if not t[0] and t[2] == IN_MAIN): {_key(t) for t in p if not t[0] and t[2] == IN_MAIN} for p in pages}
    articles.pop((), None)
    held: dict[tuple, int] = {}
    for keys in articles.values():
        for k in keys:
            held[k] = held.get(k, 0) + 1
    return {k for k, n in held.items() if n < max(MIN_PAGES, MIN_SHARE * len(articles))}


def region(pages: list[list[tuple]], template: set[tuple]) -> str:
    """The path of the template's element whose slots hold most of the varying text; "" if there is none."""
    held: dict[str, int] = {}
    for tokens in pages:
        _weigh(tokens, template, held)
    return _widest(held)


def _weigh(tokens: list[tuple], template: set[tuple], held: dict[str, int]) -> None:
    """Adds a page's varying text to what the template's elements hold, by path, and all of it to "".

    The template may be cut to the page's own tokens: each element around a run was opened on its page.
    """
    opened = {t[1] for t in tokens if t[0] == "<" and t in template}
    for t in tokens:
        if t[0] or t[2] == OUT or _key(t) in template:
            continue
        held[""] = held.get("", 0) + len(t[1])
        parts = t[3].split("/")
        for depth in range(2, len(parts) + 1):
            path = "/".join(parts[:depth])
            if path in opened:
                held[path] = held.get(path, 0) + len(t[1])
            if parts[depth - 1].partition(".")[0] in MAIN:
                break


def _widest(held: dict[str, int]) -> str:
    """Of what _weigh gathered: the innermost element that holds LEAST_SHARE of all, then as far out as that adds little,
    which takes in a headline next to a body; but no article is left nor cut."""
    strong = [p for p, n in held.items() if p and n >= LEAST_SHARE * held[""]]
    if not strong:
        return ""
    best = max(strong, key=lambda p: (p.count("/"), held[p], p))
    while best.rpartition("/")[2].partition(".")[0] not in MAIN:
        outer = best.rpartition("/")[0]
        if outer.count("/") < 3 or outer not in held or held[outer] > (1 + MORE_SHARE) * held[best]:
            break  # html and body hold menus, too
        best = outer
    return best


def slots_within(tokens: list[tuple], within: str) -> list[tuple]:
    """The runs of a page that lie in its host's region."""
    return [t for t in tokens if not t[0] and t[2] != OUT and (t[3] == within or t[3].startswith(f"{within}/"))] if within else []


def main_text(tokens: list[tuple], template: set[tuple], within: str = "") -> str:
    """The slots of one page that are main text, one block a line.

    An article that is template text all over stays: others may quote it.
    """
    runs = slots_within(tokens, within) or [t for t in tokens if not t[0] and t[2] != OUT]
    inside = [t for t in runs if t[2] == IN_MAIN]
    left = [t[1] for t in inside or runs if _key(t) not in template]
    return "\n".join(left or [t[1] for t in inside])


def _cut(blob: bytes) -> list[bytes]:
    """The digests that a blob holds one after the other."""
    return [blob[i : i + 16] for i in range(0, len(blob), 16)]


def _ints(numbers) -> bytes:
    return array("I", numbers).tobytes()


def _kept(make: Callable) -> Callable:
    """make, whose results are kept by host, a bounded number at a time."""
    kept: dict[int, object] = {}

    def get(site: int, *args):
        if site not in kept:
            if len(kept) >= HOSTS:
                kept.clear()
            kept[site] = make(*args)
        return kept[site]

    return get


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, digest, html) of distinct pages to parts of each token's vector: its pages, its occurrences and a hash of
    the set of (page, occurrences). All add up: the hash is an exclusive or."""
    held: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
    n = 0

    def parts() -> pa.RecordBatch:
        sites = np.repeat(np.array(list(held), np.int64), [len(v) for v in held.values()])
        tokens = np.frombuffer(b"".join(t for v in held.values() for t in v), np.int64).reshape(-1, 2)
        numbers = np.array([s for v in held.values() for s in v.values()], np.int64).reshape(-1, 4)
        columns = [sites, *tokens.T, *numbers.T]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["site", "a", "b", "pages", "total", "x", "y"])

    for site, page, h in rows(batches, 64):
        vectors, marks = held[site], {}
        for key, k in Counter(map(_key, parse(h))).items():
            if k not in marks:
                marks[k] = struct.unpack("<qq", xxhash.xxh3_128_digest(struct.pack("<qq", page, k)))
            x, y = marks[k]
            token = _digest(key)
            v = vectors.get(token)
            if v is None:
                vectors[token] = [1, k, x, y]
                n += 1
            else:
                v[0] += 1
                v[1] += k
                v[2] ^= x
                v[3] ^= y
        if n >= HELD:
            yield parts()
            held.clear()
            n = 0
    if n:
        yield parts()


PLAN = pa.schema([("site", pa.int64()), ("tokens", pa.binary()), ("sizes", pa.binary())])


def _arrange(frequent: pa.Table) -> pa.Table:
    """One host's frequent tokens to its classes in the order of deduce: all tokens, numbered thus, and the classes' sizes."""
    c = {name: frequent.column(name).to_pylist() for name in frequent.column_names}
    classes: dict[tuple, list[bytes]] = defaultdict(list)
    for a, b, *vector in zip(c["a"], c["b"], c["pages"], c["total"], c["x"], c["y"], strict=True):
        classes[tuple(vector)].append(struct.pack("<qq", a, b))
    order = sorted((-v[0], v[1], -len(m), sorted(m)) for v, m in classes.items() if len(m) >= MIN_TOKENS)
    if not order:
        return PLAN.empty_table()
    return pa.table([c["site"][:1], [b"".join(t for o in order for t in o[3])], [_ints(len(o[3]) for o in order)]], schema=PLAN)


def _groups(sizes: bytes) -> list[range]:
    """The numbers of each class's tokens."""
    out, at = [], 0
    for size in array("I", sizes):
        out.append(range(at, at + size))
        at += size
    return out


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, digest, html, tokens) to each page's shape (the numbers of its class tokens in order), a digest of its
    article's text, and the numbers of class tokens in that."""
    sink = Sink(pa.schema([("site", pa.int64()), ("digest", pa.int64()), ("shape", pa.binary()), ("article", pa.binary()), ("quoted", pa.binary())]))
    numbers_of = _kept(lambda blob: {t: i for i, t in enumerate(_cut(blob))})
    for site, page, h, blob in rows(batches, 64):
        numbers, shape, quoted, article = numbers_of(site, blob), [], set(), []
        for t in parse(h):
            number = numbers.get(_digest(_key(t)))
            if number is not None:
                shape.append(number)
            if not t[0] and t[2] == IN_MAIN:
                article.append(t[1])
                if number is not None:
                    quoted.add(number)
        told = xxhash.xxh3_128_digest("\n".join(article).encode()) if article else None
        if sink.add(site, page, _ints(shape), told, _ints(sorted(quoted)), size=4 * len(shape)):
            yield sink.batch()
    if sink.n:
        yield sink.batch()


def _gathered(batches: Iterator[pa.RecordBatch], schema: pa.Schema, see: Callable[[dict, tuple], None]) -> Iterator[pa.RecordBatch]:
    """What see() gathers of all rows in a dictionary, as rows of (*key, value), in parts of bounded size."""
    sink, held = Sink(schema), {}

    def out() -> Iterator[pa.RecordBatch]:
        for key, value in held.items():
            if sink.add(*key, value):
                yield sink.batch()
        held.clear()
        if sink.n:
            yield sink.batch()

    for row in rows(batches, 64):
        see(held, row)
        if len(held) >= HELD:
            yield from out()
    yield from out()


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, shape, sizes) to the order of each class's tokens in these shapes; null where it has none."""
    groups_of = _kept(_groups)

    def see(held: dict, row: tuple) -> None:
        site, shape, sizes = row
        seen: dict[int, list[int]] = defaultdict(list)
        groups = groups_of(site, sizes)
        place = [i for i, g in enumerate(groups) for _ in g]
        for t in array("I", shape):
            seen[place[t]].append(t)
        for i, found in seen.items():
            step = len(groups[i])
            order = found[:step]
            once = _ints(order) if found == order * (len(found) // step) else None
            held[site, i] = once if held.get((site, i), once) == once else None

    return _gathered(batches, pa.schema([("site", pa.int64()), ("class", pa.int32()), ("tokens", pa.binary())]), see)


def _faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, shape, sizes, rejected) to a host's first class, of those not rejected, that some of these shapes holds in
    more than one gap of the classes before it."""
    groups_of = _kept(_groups)

    def see(held: dict, row: tuple) -> None:
        site, shape, sizes, rejected = row
        tokens, template, out = array("I", shape), set(), set(rejected or ())
        for i, group in enumerate(groups_of(site, sizes)[: held.get((site,))]):
            if i in out:
                continue
            if template and len(_gaps(tokens, template, group)) > 1:
                held[site,] = i
                return
            template.update(group)

    return _gathered(batches, pa.schema([("site", pa.int64()), ("class", pa.int32())]), see)


def _quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, quoted) of distinct articles to the number of articles that hold each token; -1 stands for all articles."""

    def see(held: dict, row: tuple) -> None:
        for number in (-1, *array("I", row[1])):
            held[row[0], number] = held.get((row[0], number), 0) + 1

    return _gathered(batches, pa.schema([("site", pa.int64()), ("number", pa.int64()), ("articles", pa.int64())]), see)


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, tokens, sizes, rejected classes, copied tokens) to the digests of the template's tokens."""
    sink = Sink(pa.schema([("site", pa.int64()), ("template", pa.binary())]))
    for site, blob, sizes, rejected, copied in rows(batches, 64):
        tokens, classes, quoted = _cut(blob), set(rejected or ()), set(copied or ())
        kept = [tokens[t] for i, g in enumerate(_groups(sizes)) if i not in classes for t in g if t not in quoted]
        if kept and sink.add(site, b"".join(kept), size=16 * len(kept)):
            yield sink.batch()
    if sink.n:
        yield sink.batch()


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, html, template) to what the template's elements hold on these pages."""
    template_of = _kept(lambda blob: frozenset(_cut(blob)))

    def see(held: dict, row: tuple) -> None:
        template, tokens, weights = template_of(row[0], row[2]), parse(row[1]), {}
        _weigh(tokens, {k for k in set(map(_key, tokens)) if _digest(k) in template}, weights)
        for path, n in weights.items():
            held[row[0], path] = held.get((row[0], path), 0) + n

    return _gathered(batches, pa.schema([("site", pa.int64()), ("path", pa.string()), ("n", pa.int64())]), see)


def templates(keyed: DataFrame) -> DataFrame:
    """(site, digest, html) to site, template, region: digests of the template's tokens, one after the other, and the path
    of its region; a site is a host's hash, and those without a template are left out.

    It gives what deduce and region give for all distinct pages of a host, in the order of their digests. Pages stay where
    they are, but for those that repeat, of which one each moves. Tokens' vectors are compared by their numbers of pages
    and occurrences and a hash of 128 bits; what goes on to a host's task is frequent tokens, which a page's length bounds.
    """
    digests = stored(keyed.groupBy("site", "digest").agg(F.count(F.lit(1)).alias("copies")), "digests")
    sites = stored(digests.groupBy("site").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAGES), "sites")
    many = sites.count()
    if not many:
        discard(digests, sites)
        return keyed.sparkSession.createDataFrame([], "site long, template binary, region string")
    repeated = stored(digests.where("copies > 1").join(sites, "site", "left_semi").select("site", "digest"), "repeated")
    copies = stored(keyed.join(repeated, ["site", "digest"], "left_semi").groupBy("site", "digest").agg(F.first("html").alias("html")), "copies")
    distinct = bounded(keyed.join(repeated, ["site", "digest"], "left_anti").select("site", "digest", "html").unionByName(copies))

    parts = distinct.mapInArrow(_tally, "site long, a long, b long, pages long, total long, x long, y long")
    vectors = parts.groupBy("site", "a", "b").agg(F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    frequent = vectors.where(F.col("pages") >= MIN_PAGES).join(sites, "site").where(F.col("pages") >= MIN_SHARE * F.col("n")).drop("n")
    plan = stored(frequent.groupBy("site").applyInArrow(_arrange, "site long, tokens binary, sizes binary"), "plans", many)

    outlines = distinct.join(plan.select("site", "tokens"), "site").mapInArrow(_outline, "site long, digest long, shape binary, article binary, quoted binary")
    outlines = stored(outlines, "outlines")
    shapes = stored(outlines.select("site", "shape").distinct(), "shapes")
    classed = shapes.join(plan.select("site", "sizes"), "site")
    orders = classed.mapInArrow(_orders, "site long, class int, tokens binary").groupBy("site", "class")
    told = orders.agg(F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.max(F.col("tokens").isNull()).alias("none"))
    rejected = [stored(told.where("none OR least <> most").select("site", "class"), "unordered", many)]
    out = lambda: reduce(DataFrame.unionByName, rejected).groupBy("site").agg(F.collect_set("class").alias("rejected"))
    # A class's gaps depend on the classes taken before it: each round settles a host up to its first fault.
    left = classed
    while True:
        found = left.join(out(), "site", "left").mapInArrow(_faults, "site long, class int")
        faults = stored(found.groupBy("site").agg(F.min("class").alias("class")), "faults", many)
        rejected.append(faults)
        if faults.isEmpty():
            break
        left = classed.join(faults.select("site"), "site", "left_semi")

    articles = outlines.where("article IS NOT NULL").groupBy("site", "article").agg(F.max_by("quoted", "digest").alias("quoted")).select("site", "quoted")
    quotes = articles.mapInArrow(_quotes, "site long, number long, articles long").groupBy("site", "number").agg(F.sum("articles").alias("articles"))
    quotes = stored(quotes, "quotes")
    whole = quotes.where("number = -1").selectExpr("site", "articles AS whole")
    few = quotes.where("number >= 0").join(whole, "site").where(F.col("articles") < F.greatest(F.lit(float(MIN_PAGES)), MIN_SHARE * F.col("whole")))
    copied = few.groupBy("site").agg(F.collect_set("number").alias("copied"))
    kept = plan.join(out(), "site", "left").join(copied, "site", "left").select("site", "tokens", "sizes", "rejected", "copied")
    template = stored(kept.mapInArrow(_left, "site long, template binary"), "template", many)

    held = distinct.join(template, "site").select("site", "html", "template").mapInArrow(_weights, "site long, path string, n long")
    held = held.groupBy("site", "path").agg(F.sum("n").alias("n"))
    schema = pa.schema([("site", pa.int64()), ("region", pa.string())])

    def choose(t: pa.Table) -> pa.Table:
        held = dict(zip(t.column("path").to_pylist(), t.column("n").to_pylist(), strict=True))
        return pa.table([t.column("site").slice(0, 1).to_pylist(), [_widest(held)]], schema=schema)

    regions = held.groupBy("site").applyInArrow(choose, "site long, region string")
    fitted = stored(template.join(regions, "site", "left"), "templates", many)
    discard(digests, sites, repeated, copies, plan, outlines, shapes, quotes, template, *rejected)
    return fitted


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and by_template (whether the deduced region told the text) of every page.

    Where the templates are small they are broadcast and no page moves for them; else the join can be split at a hot
    host. Equal pages count once in a deduction, which takes in every page of a host.

    Defined cases: null or empty html gives an empty text; pages of null or malformed urls share a host; a host with
    fewer than MIN_PAGES distinct pages has no template and relies on the elements alone; repeated rows stay; null ids
    stay; other columns are ignored; an empty table gives no rows.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("by_template", pa.bool_())])
    url = F.coalesce(pages[url_col].cast("string"), F.lit(""))
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    keyed = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), html.alias("html"), host.alias("host"))
    keyed = keyed.withColumn("site", F.xxhash64("host"))
    fitted = templates(keyed.select("site", F.xxhash64("html").alias("digest"), "html"))
    dealt = keyed.join(fitted, "site", "left").select("page_id", "url", "html", "site", "template", "region")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, held_of = Sink(schema), _kept(lambda blob: frozenset(_cut(blob)))
        for key, at, h, site, blob, within in rows(batches, 64):
            held, tokens = held_of(site, blob or b""), parse(h)
            template = {k for k in {_key(t) for t in tokens if not t[0] and t[2] != OUT} if _digest(k) in held} if held else set()
            text = main_text(tokens, template, within or "")
            if sink.add(key, at, text, len(text), bool(slots_within(tokens, within or "")), size=len(text)):
                yield sink.batch()
        if sink.n:
            yield sink.batch()

    return bounded(dealt).mapInArrow(run, "page_id long, url string, text string, n_chars long, by_template boolean")
