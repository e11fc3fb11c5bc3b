import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from lamina.llm import html
from lamina.llm.html import deduce, extract, main_text, parse


def text(html, template=frozenset()):
    return main_text(parse(html), set(template))


@pytest.mark.parametrize(
    "html,expected",
    [
        ("", ""), ("plain", "plain"), ("a<b>b</b> c<p>d &lt;x&gt; &nbsp; e", "ab c\nd <x> e"), ("x < y and <3", "x < y and <3"),
        ("<p>one\n two\t three<p>four", "one two three\nfour"), ("<article><h1>T</h1><p>a<br>b</article><p>out", "T\na\nb"),
        ("<title>no</title><script>var t='</p><p>x';</script><style>p{}</style><p>yes", "yes"), ("<p>un<!-- open <p>x", "un"),
        ("<nav>n</nav><header>h</header><aside>s</aside><form>f</form><p>ok<footer>f</footer>", "ok"),
        ("<main><header><h1>T</h1></header><div class='post-comments'>c</div><p>x</p></main>", "T\nx"),
        ("<div class=sidebar>z</div><div id=content>ok<form>q</form> more</div>", "ok\nmore"), ("<div role='navigation'>n</div>ok", "ok"),
        ("<div class='cookieNotice'>n</div><div class=additional>ok</div>", "ok"), ("<p hidden>h</p>ok <div style='display: none'>x</div>", "ok"),
        ("<article><p>a</p><aside>no</aside><section id='comments'><article><p>c</p></article></section></article>", "a"),
        ("<article class='comment'>c</article><article>a</article>", "a"), ("<span class='ad'>x<span>y</span>z</span>ok", "ok"),
        ("<article>&amp;&copy;&#65;&bogus; &am</article>", "&©A&bogus; &am"), ("<a <b <c", ""), ("<p>a</div></p></span>b", "a\nb"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"), ("<article><p>t<svg><path d='m'/></svg>u</p></article>", "t u"),
        ('<p title="a>b">c</p>', "c"), ("<article><p>q</p>", "q"),
    ],
)
def test_pages(html, expected):
    assert text(html) == expected


def page(i, body, extra=""):
    return f"<html><body><div><p>Welcome to our site</p><p>User {i} visits</p></div><div>{body}</div>{extra}<div><p>Copyright of all</p></div></body></html>"


def test_template():
    """Text that all pages of a host share is template, what differs is a slot; an article's text is never template."""
    parsed = [parse(page(i, f"<p>own text {i}</p>")) for i in range(6)]
    template = deduce(parsed)
    assert main_text(parsed[3], template) == "User 3 visits\nown text 3"
    assert deduce(parsed[:4]) == set()  # too few pages to tell
    same = [parse(page(i, "<article><p>a quoted passage</p></article>")) for i in range(8)]
    assert main_text(same[0], deduce(same)) == "a quoted passage"


def test_a_class_out_of_order_is_no_template():
    def shuffled(i):
        first, second = ("<p>alpha</p>", "<p>beta</p>") if i % 2 else ("<p>beta</p>", "<p>alpha</p>")
        return parse(first + second + f"<p>{i}</p>")

    pages = [shuffled(i) for i in range(8)]
    assert not {t for t in deduce(pages) if t[0] == ""}


SCHEMA = "page_id long, url string, html string, host string, text string"


def test_extract(spark):
    rows = [(i, f"http://Site.example/{i}?x", page(i, f"<p>own text {i}</p>"), "clash", "clash") for i in range(150)]
    rows += [(200, None, "<p>a</p>", "h", "t"), (201, "bad", None, "h", "t"), (None, "http://x.y/", "", "h", "t"), (203, "http://x.y/", "<p>" + "w " * 200_000, "h", "t")]
    rows += [(300 + i, "http://copies.example/", "<p>copied</p><p>twice</p>", "h", "t") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r for r in extract(df).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert {got[i].text for i in range(150)} == {f"User {i} visits\nown text {i}" for i in range(150)}
    assert (got[200].text, got[201].text, got[None].text, got[203].n_chars) == ("a", "", "", 399_999)
    assert {got[300 + i].text for i in range(40)} == {"copied\ntwice"}  # copies are one page, and no template
    assert extract(df.limit(0)).collect() == []


def article(i, own):
    return parse(f"<html><body><article><h1>T {i}</h1><p>{own}</p><div><p>Read also</p><p>Our best stories</p></div></article></body></html>")


def test_template_text_in_articles():
    """What a host repeats in its articles is template; what copies of one article share is not, nor a whole article."""
    pages = [article(i, f"own text {i}") for i in range(10)]
    assert main_text(pages[3], deduce(pages)) == "T 3\nown text 3"
    copies = [parse(f"<p>visit {i}</p><article><h1>T</h1><p>a</p><p>b</p></article>") for i in range(20)]
    others = [parse(f"<p>visit {i}</p><article><h1>U {i}</h1><p>c {i}</p></article>") for i in range(4)]
    assert main_text(copies[0], deduce(copies + others)) == "T\na\nb"
    quoted = parse("<html><body><article><div><p>Read also</p><p>Our best stories</p></div></article></body></html>")
    assert main_text(quoted, deduce([*pages, quoted])) == "Read also\nOur best stories"


def test_one_template_for_a_host(spark):
    """Wherever a host's pages are, and however many or large, they share one template."""
    rows = [(i, "http://last.example/", page(i, f"<p>own text {i}</p>"), "h", "t") for i in range(66)]
    rows += [(1000 + i, "http://large.example/", page(i, f"<p>own text {i}</p><p>{'w ' * 1_100_000}</p>"), "h", "t") for i in range(9)]
    rows += [(2000 + i, "http://copied.example/", page(max(0, i - 70), f"<p>own text {max(0, i - 70)}</p>"), "h", "t") for i in range(76)]
    got = {r.page_id: r.start for r in extract(spark.createDataFrame(rows, SCHEMA)).selectExpr("page_id", "substr(text, 1, 40) AS start").collect()}
    assert len(got) == len(rows) and {t.split("\n")[0] for t in got.values()} <= {f"User {i} visits" for i in range(66)}


def plain_names(page):
    """The page without the element that says where its article is."""
    return re.sub(r"<(/?)article", r"<\1div", page)


def by_host(rows):
    hosts = defaultdict(dict)
    for _, url, page in rows:
        hosts[re.search(r"://([^/?#]*)", url)[1].lower()].setdefault(page, None)
    return hosts


def test_the_template_decides(spark, monkeypatch):
    """Without article elements and without any class word, the deduced region alone gives the same text."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").limit(600).collect()]
    monkeypatch.setattr(html, "MARKS", set())
    monkeypatch.setattr(html, "MARKS_OUTSIDE", set())
    fitted = {}
    for host, pages in by_host(rows).items():
        parsed = [html.parse(plain_names(p)) for p in pages]
        template = html.deduce(parsed)
        fitted[host] = {t for t in template if not t[0]}, html.region(parsed, template)
    told = changed = 0
    for _, url, page in rows:
        template, within = fitted[re.search(r"://([^/?#]*)", url)[1].lower()]
        if within:
            tokens, want = html.parse(plain_names(page)), html.main_text(html.parse(page), set())
            assert html.main_text(tokens, template, within) == want
            told, changed = told + 1, changed + (html.main_text(tokens, set()) != want)
    assert told > 400 and changed > 0.9 * told


def test_against_a_brute_force_template(spark):
    """Pages made of known template parts and known slots, with other class names on each host: what the deduction keeps
    is what was put into the body's slot, whatever the partitions."""
    rng, rows, want = random.Random(4), [], {}
    words = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(n))
    for h in range(4):
        menu, foot, box = words(5), words(4), words(6)
        for i in range(9 + 40 * (h == 0)):
            body = [words(rng.randint(8, 60)) for _ in range(rng.randint(2, 5))]
            paragraphs = "".join(f"<p>{b}</p>" for b in body)
            page = f"<html><body><div class=q{'x' * h}>{menu}</div><div class=teaser><p>{words(3)}</p></div><div class=zz><h2>{body[0]} !</h2>{paragraphs}<p>{box}</p></div><div class=end>{foot}</div></body></html>"
            want[len(rows)] = "\n".join([f"{body[0]} !", *body])
            rows.append((len(rows), f"http://h{h}.example.com/{i}", page))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for partitions in (1, 7, 50):
        got = {r.page_id: r for r in html.extract(df.repartition(partitions)).collect()}
        assert {i: r.text for i, r in got.items()} == want and all(r.by_template for r in got.values())


def test_counts_come_from_all_pages(spark):
    """A box is template where at least 0.8 of all the host's distinct pages hold it, and text where fewer do."""
    rng, rows, want = random.Random(7), [], {}
    words = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(n))
    for holding in range(114, 126):
        menu, foot, first, second = words(5), words(4), words(6), words(3)
        for i in rng.sample(range(150), 150):
            body, key = [words(rng.randint(30, 60)) for _ in range(3)], len(rows)
            box = f"<div class=box><p>{first}</p><p>{second}</p></div>" if i < holding else ""
            inner = f"<h2>{body[0]} !</h2>{''.join(f'<p>{b}</p>' for b in body)}{box}"
            page = f"<html><body><div class=q>{menu}</div><div class=zz>{inner}</div><div class=end>{foot}</div></body></html>"
            want[key] = "\n".join([f"{body[0]} !", *body, *([first, second] if box and holding < 120 else [])])
            rows += [(key + c, f"http://h{holding}.example.com/{i}", page) for c in range(1 + (i % 50 == 0))]
            want |= {key + c: want[key] for c in range(1 + (i % 50 == 0))}
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == want


def odd_host(rng, n):
    """Pages whose parts repeat, come in two orders, wander between gaps, sit on shares about 0.8, or quote one another."""
    parts = [f"<div class=part{c}><b>{c} one</b><p>{c} two</p><p>{c} three</p></div>" for c in "abcdefg"]
    shares, kind, quoted = [rng.choice([0.7, 0.8, 0.9, 1, 1]) for _ in parts], [rng.choice("fffwrt") for _ in parts], f"quoted {rng.random()}"
    out = []
    for i in range(n):
        there = [(k, p) for k, p, s in zip(kind, parts, shares, strict=True) if rng.random() < s]
        fixed = [p * (rng.randint(1, 3) if k == "r" else 1) for k, p in there if k != "w"]
        for k, p in there:
            if k == "w":
                for _ in range(2):
                    fixed.insert(rng.randint(0, len(fixed)), p)
            elif k == "t" and rng.random() < 0.5:
                fixed[-1] = fixed[-1].replace("two", "tmp").replace("three", "two").replace("tmp", "three")
        inside = "".join(f"<p>{quoted if rng.random() < 0.2 else rng.random()}</p>" for _ in range(rng.randint(0, 3)))
        wrap = rng.choice(["article", "article", "div class=body"])
        at = rng.randint(0, len(fixed))
        body = f"<{wrap}><h1>T {i % 9}</h1>{inside}{rng.choice(parts) if rng.random() < 0.9 else ''}</{wrap.split()[0]}>"
        out.append(f"<html><body>{''.join(fixed[:at])}{body}{''.join(fixed[at:])}</body></html>")
    return out


def test_tables_give_what_memory_gives(spark):
    """Templates and regions of a table are those of deduce and region for all distinct pages of a host."""
    rng = random.Random(11)
    rows = [(h, p) for h in range(40) for p in odd_host(rng, rng.choice([4, 5, 12, 40, 130])) for _ in range(rng.choice([1, 1, 1, 3]))]
    df = spark.createDataFrame(rows, "site long, html string").selectExpr("site", "xxhash64(html) AS digest", "html")
    pages = defaultdict(dict)
    for r in df.collect():
        pages[r.site][r.digest] = r.html
    want = {}
    for site, by_digest in pages.items():
        parsed = [parse(by_digest[d]) for d in sorted(by_digest)]
        if found := deduce(parsed):
            want[site] = {html._digest(k) for k in found}, html.region(parsed, found)
    assert 20 < len(want) < 40 and len({len(t) for t, _ in want.values()}) > 5
    for partitions in (1, 9):
        got = {r.site: (set(html._cut(bytes(r.template))), r.region or "") for r in html.templates(df.repartition(partitions)).collect()}
        assert got == want


def test_rejected_classes_take_rounds(spark):
    """Classes that lie in several gaps of those before them go one after the other, as in memory."""
    part = lambda c: f"<div class={c}><b>{c} 1</b><p>{c} 2</p><p>{c} 3</p></div>"
    rows = [(1, f"<html><body>{part('a')}{part('x') * 2}{part('y') * 2}{part('b')}{part('x') * 2}{part('y') * 2}<p>{i}</p></body></html>") for i in range(12)]
    parsed = [parse(p) for _, p in rows]
    assert not {k for k in deduce(parsed) if not k[0] and k[1][0] in "xy"} and {k for k in deduce(parsed) if k[1] == "a 2"}
    df = spark.createDataFrame(rows, "site long, html string").selectExpr("site", "xxhash64(html) AS digest", "html")
    got = html.templates(df).collect()
    assert {t for r in got for t in html._cut(bytes(r.template))} == {html._digest(k) for k in deduce(parsed)}


def test_part_sums(monkeypatch):
    """Vectors given out in parts add up to those given out at once."""
    rng, pages = random.Random(5), []
    for site in range(3):
        pages += [(site, i, p) for i, p in enumerate(odd_host(rng, 20))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pages, strict=True)], names=["site", "digest", "html"])

    def vectors():
        out, parts = defaultdict(lambda: [0, 0, 0, 0]), list(html._tally(iter([batch])))
        for part in parts:
            for site, a, b, n, total, x, y in zip(*(c.to_pylist() for c in part.columns), strict=True):
                v = out[site, a, b]
                out[site, a, b] = [v[0] + n, v[1] + total, v[2] ^ x, v[3] ^ y]
        return dict(out), len(parts)

    once, one = vectors()
    monkeypatch.setattr(html, "HELD", 1)
    again, many = vectors()
    assert again == once and (one, many) == (1, 60)
