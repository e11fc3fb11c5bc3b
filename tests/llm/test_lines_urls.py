import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lamina.llm.lines import LineRuns, brute_force, drop_common_lines, line_hashes
from lamina.llm.queries import op8_urls
from lamina.llm.urls import judge

SCHEMA = "doc_id long, text string, rk string, line int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in texts.items()], SCHEMA)


def outcome(df):
    rows = df.withColumn("sha", F.sha2("text", 256)).collect()
    return {r.doc_id: (r.n_lines, r.n_dropped, r.sha) for r in rows}


def corpus(n=60):
    rng = random.Random(7)
    common = ["Shared Line", "  shared line\t", "SHARED LINE", "Ä rare", "ä rare", "", " ", "\x0b\x0c", "\x85x"]
    out = {i: "\n".join(rng.choice(common) if rng.random() < 0.4 else f"own {i} {rng.random()}" for _ in range(rng.randint(1, 12))) for i in range(n)}
    return out | {900: None, 901: "", 902: "\n\n", 903: "Shared Line", 904: "x" * 200_000, 905: "\n".join(["shared line"] * 5000)}


def test_against_brute_force(spark):
    texts = corpus()
    got = drop_common_lines(frame(spark, texts), min_docs=10)
    assert got.columns == ["doc_id", "text", "rk", "line", "n_lines", "n_dropped"] and outcome(got) == brute_force(texts, 10)
    assert any(v[1] for v in outcome(got).values())


def test_short_keys_and_names(spark):
    texts = {i: "ab\nabc" for i in range(12)}
    got = drop_common_lines(frame(spark, texts), min_docs=10, min_chars=3, n_lines="line", n_dropped="gone").collect()
    assert {(r.text, r.line, r.gone) for r in got} == {("ab", 2, 1)}


def test_repeated_and_null_rows(spark):
    df = spark.createDataFrame([(None, "a\nb")] * 6 + [(1, "a\nc")] * 5, "doc_id long, text string")
    got = Counter((r.doc_id, r.text, r.n_dropped) for r in drop_common_lines(df, min_docs=10).collect())
    assert got == {(None, "b", 1): 6, (1, "c", 1): 5}
    assert drop_common_lines(df.limit(0)).collect() == []


def test_batches_meet_in_the_runs(spark):
    texts = corpus(50)
    runs = LineRuns(spark, fanout=3)
    keys = sorted(texts)
    for at in range(0, len(keys), 8):
        last = drop_common_lines(frame(spark, {k: texts[k] for k in keys[at : at + 8]}), min_docs=10, runs=runs)
    levels = runs.levels()
    assert len(levels) > 1 and all(len(level) < 3 for level in levels)  # seven batches were compacted
    whole = LineRuns(spark)
    drop_common_lines(frame(spark, texts), runs=whole)
    assert sorted(map(tuple, runs.counts().collect())) == sorted(map(tuple, whole.counts().collect()))
    want = brute_force(texts, 10)  # the last batch sees the counts of all
    assert outcome(last) == {k: want[k] for k in keys[(len(keys) - 1) // 8 * 8 :]}
    runs.remove()
    assert runs.levels() == [] and LineRuns(spark).counts().count() == 0


def test_runs_are_sorted(spark):
    runs = LineRuns(spark)
    drop_common_lines(frame(spark, corpus()), runs=runs)
    found = runs.counts().withColumn("file", F.input_file_name()).collect()
    by = {}
    for r in found:
        by.setdefault(r.file, []).append((r.h1, r.h2))
    assert all(v == sorted(v) for v in by.values())


def test_hashes(spark):
    df = spark.createDataFrame([(b"k", "A b\na B \nÄ")], "rk binary, text string")
    rows = line_hashes(df).collect()
    assert [r.line for r in rows] == [0, 1, 2] and [r.first for r in rows] == [True, False, True] and rows[0].h1 == rows[1].h1 != rows[2].h1


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("Net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "", "block"), (None, "/x", "block")]


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for sign in "?#":
            rest = rest.split(sign, 1)[0]
        host, _, tail = rest.partition("/")
        path = rest[len(host) :]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h.lower() + p, v) for h, p, v in rules if h is not None and host and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


URLS = [
    None, "", "no scheme", "http://", "http:///en/", "http://com/en/1", "http://COM/en/", "https://a.example.com/en/71?q#f", "http://example.com/en/6", "x://notexample.com/en/7", "http://xcom/en/1",
    "http://a.b.net/de/8/9", "http://net/de", "http://net?/de/", "http://net#/de/", "http://org", "http://É.org/x", "http://a.ORG:80/", "http://org:80/", "a://b://com/en/", "http://example.net/de/8", "http://" + "a." * 60 + "com/en/" + "z" * 5000,
]


@pytest.mark.parametrize("rules", [RULES, [], RULES + [(f"h{i}.com", f"/p{i}", "block") for i in range(500)]])
def test_urls(spark, rules):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)] * 2, "page_id long, url string, verdict string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    rows = judge(pages, listed).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, rules), r.url


#: As op8's contract lists them.
CONTRACT = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def test_query_judges_by_its_contract(spark, tmp_path):
    urls = URLS + [f"http://{sub}{host}{path}" for host, path, _ in CONTRACT for sub in ("", "a.", "A.b.", "x") for path in (path, path + "1", path[:-1])]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op8_urls(spark, str(tmp_path)).collect()}
    assert got == {i: plain(u, CONTRACT) for i, u in enumerate(urls)}
    assert {rule: verdict for _, _, rule, verdict in got.values() if rule} == {h + p: v for h, p, v in CONTRACT}


def test_urls_without_broadcast(spark, monkeypatch):
    import lamina.llm.urls as module

    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert {r.page_id: r.verdict for r in judge(pages, listed, default="block").collect()} == {i: plain(u, RULES, "block")[3] for i, u in enumerate(URLS)}
    assert judge(pages.limit(0), listed).collect() == []


def test_runs_meet_without_a_shuffle(spark):
    """A run is bucketed and sorted: the merge join with it needs no exchange on either side."""
    runs = LineRuns(spark, buckets=5)
    for at in range(2):
        runs.add(spark.range(at * 20, at * 20 + 30).selectExpr("id * 7919 AS h1", "id AS h2", "1L AS n"))
    one, other = (runs._table(n) for n in runs.levels()[0])
    plan = one.hint("merge").join(other, ["h1", "h2"], "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    found = runs.add(spark.range(10, 40).selectExpr("id * 7919 AS h1", "id AS h2", "1L AS n"), least=3).collect()
    assert sorted((r.h2, r.n) for r in found) == [(i, 3) for i in range(20, 30)]
    runs.remove()


def test_a_batch_counts_once(spark):
    runs, texts = LineRuns(spark), corpus(30)
    first = sorted(map(tuple, outcome(drop_common_lines(frame(spark, texts), runs=runs, batch="monday")).items()))
    held = sorted(map(tuple, runs.counts().collect()))
    again = LineRuns(spark, runs.path)
    assert sorted(map(tuple, outcome(drop_common_lines(frame(spark, texts), runs=again, batch="monday")).items())) == first
    assert sorted(map(tuple, again.counts().collect())) == held and again.state()["batches"] == ["monday"]
    runs.remove()


def test_working_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a\nb", "x", "y"), (2, None, None, "z")], "doc_id long, text string, __rk string, __kept string")
    got = drop_common_lines(df, min_docs=5).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r["__rk"], r["__kept"], r.n_lines) for r in got] == [(1, "a\nb", "x", "y", 2), (2, "", None, "z", 1)]
    pages = spark.createDataFrame([(1, "http://a.com/en/x", "kept")], "page_id long, url string, __url string")
    rules = spark.createDataFrame([("com", "/en/", "block")], "host string, path string, verdict string")
    row = judge(pages, rules).first()
    assert row["__url"] == "kept" and row.verdict == "block"
