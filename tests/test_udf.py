import importlib.util
import shutil
from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
import pyarrow as pa
import pytest

from lamina import api
from lamina.errors import SchemaError, ValidationError
from lamina.operators.extensions import CoTransformer, OutputTransformer, Transformer
from lamina.operators.frames import EmptyAwareIterable, Frames, Signature
from lamina.operators.output import frame, same


def check(df, rows, schema):
    assert same(df, rows, schema, throw=True)


@pytest.fixture
def ab(spark):
    return frame(spark, [[1, 2], [1, 5], [None, 3], [None, 4], [2, 1]], "a:int,b:int")


# schema: *,n:int
def sized(df: pd.DataFrame) -> pd.DataFrame:
    return df.assign(n=len(df))


def test_keyed(ab):
    check(api.transform(ab, sized, partition="a"), [[1, 2, 2], [1, 5, 2], [None, 3, 2], [None, 4, 2], [2, 1, 1]], "a:int,b:int,n:int")

    def first(df: pd.DataFrame) -> pd.DataFrame:
        return df.head(1)

    check(api.transform(ab, first, "*", partition={"by": "a", "presort": "b desc"}), [[1, 5], [None, 4], [2, 1]], "a:int,b:int")


def test_nan_keys_are_null(spark):
    df = spark.sql("SELECT * FROM VALUES (CAST('NaN' AS DOUBLE), 1), (NULL, 2) AS t(a, b)")
    check(api.transform(df, sized, partition="a"), [[None, 1, 2], [None, 2, 2]], "a:double,b:int,n:int")


@pytest.mark.parametrize("partition", [None, 2, {"by": "a", "algo": "coarse", "num": 2}])
def test_forms(ab, partition):
    def lists(rows: list[list[Any]]) -> list[list[Any]]:
        return [[r[1]] for r in rows]

    def dicts(rows: Iterable[dict[str, Any]]) -> Iterable[dict[str, Any]]:
        for r in rows:
            yield {"x": r["b"]}

    def aware(rows: EmptyAwareIterable[list[Any]]) -> Iterable[list[Any]]:
        assert not rows.empty and len(rows.peek()) == 2
        for r in rows:
            yield [r[1]]

    def arrow(t: pa.Table) -> pa.Table:
        return pa.table({"x": t.column("b")})

    def frames(dfs: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for df in dfs:
            yield df.rename(columns={"b": "x"})

    def tables(ts: Iterable[pa.Table]) -> Iterable[pa.Table]:
        for t in ts:
            yield pa.table({"x": t.column("b")})

    for fn in (lists, dicts, aware, arrow, frames, tables):
        check(api.transform(ab, fn, "x:int", partition=partition), [[2], [5], [3], [4], [1]], "x:int")


def test_one_dict(ab):
    def total(rows: list[dict[str, Any]]) -> dict[str, Any]:
        return {"a": rows[0]["a"], "t": sum(r["b"] for r in rows)}

    check(api.transform(ab, total, "a:int,t:long", partition="a"), [[1, 7], [None, 7], [2, 1]], "a:int,t:long")


def test_params_and_schema(ab):
    def add(df: pd.DataFrame, n: int, m: int = 0) -> pd.DataFrame:
        return df.assign(c=n + m)

    out = api.transform(ab, add, lambda s, n, m: "*,c:long", params={"n": 2, "m": 3})
    assert {r.c for r in out.collect()} == {5} and out.columns == ["a", "b", "c"]
    with pytest.raises(ValidationError):
        api.transform(ab, add, "*,c:long", params={"zz": 1})
    with pytest.raises(SchemaError):
        api.transform(ab, add, params={"n": 1})


def test_ignored_errors(ab):
    def fails(df: pd.DataFrame) -> pd.DataFrame:
        if len(df) > 1:
            raise NotImplementedError
        return df

    check(api.transform(ab, fails, "*", partition="a", ignore_errors=[NotImplementedError]), [[2, 1]], "a:int,b:int")
    with pytest.raises(Exception, match="NotImplementedError"):
        api.transform(ab, fails, "*", partition="a").collect()


def test_empty_input(ab):
    assert api.transform(ab.limit(0), sized).count() == 0 and api.transform(ab.limit(0), sized, partition="a").columns == ["a", "b", "n"]


def test_nested_output(ab):
    def nest(rows: Iterable[dict[str, Any]]) -> Iterable[dict[str, Any]]:
        for r in rows:
            yield {"l": [r["b"]], "s": {"x": r["b"], "y": "z"}}

    out = api.transform(ab, nest, "l:[int],s:{x:int,y:str}")
    assert sorted(r.s.x for r in out.collect()) == [1, 2, 3, 4, 5]


def test_limits(ab):
    out = api.transform(ab.coalesce(1), sized, partition={"row_limit": 2})
    assert sorted(r.n for r in out.collect()) == [1, 2, 2, 2, 2]


def test_callback(ab):
    seen = []

    def tell(rows: list[list[Any]], say: Callable) -> None:
        say(len(rows))

    def maybe(rows: list[list[Any]], say: Callable | None = None) -> None:
        assert say is None

    api.out_transform(ab, tell, partition="a", callback=seen.append)
    assert sorted(seen) == [1, 2, 2]
    api.out_transform(ab, maybe)


def test_classes(ab):
    class Add(Transformer):
        def get_output_schema(self, schema):
            return "*,k:str,no:int"

        def on_init(self, schema):
            self.ready = True

        def transform(self, df):
            assert self.ready
            return df.assign(k=str(self.cursor.key_value_dict), no=self.params["n"])

    out = api.transform(ab, Add, partition="a", params={"n": 3})
    assert {r.k for r in out.collect()} == {"{'a': 1}", "{'a': None}", "{'a': 2}"}

    class Out(OutputTransformer):
        def process(self, df):
            self.callback(len(df))

    seen = []
    api.out_transform(ab, Out, partition="a", callback=seen.append)
    assert sorted(seen) == [1, 2, 2]


def test_rules(ab):
    @api.transformer("*", partitionby_has="a", presort_is="b desc", input_has="a,b:int")
    def ruled(df: pd.DataFrame) -> pd.DataFrame:
        return df

    assert api.transform(ab, ruled, partition={"by": ["a"], "presort": "b desc"}).count() == 5
    for wrong in (None, "a", {"by": ["a"], "presort": "b"}):
        with pytest.raises(ValidationError):
            api.transform(ab, ruled, partition=wrong)
    with pytest.raises(ValidationError):
        api.transform(ab.select("a"), ruled, partition={"by": ["a"], "presort": "b desc"})
    with pytest.raises(ValidationError):
        api.transformer("*", zz=1)


def test_path_and_registry(spark, ab, tmp_path):
    path = str(tmp_path / "x.parquet")
    ab.write.parquet(path)
    api.register_transformer("sized_one", sized)
    assert api.transform(path, "sized_one", spark=spark).count() == 5
    with pytest.raises(ValueError):
        api.transform(str(tmp_path / "x.csv"), sized, spark=spark)
    saved = api.transform(ab, sized, partition="a", save_path=str(tmp_path / "y.parquet"))
    assert saved.count() == 5 and api.transform(ab, sized, as_local=True).shape == (5, 3)
    with pytest.raises(ValidationError):
        api.transform(ab, "absent")


def test_signature():
    def fn(df: pd.DataFrame, f: Callable, n=1, **kw) -> None: ...

    s = Signature.read(fn)
    assert (s.frames, s.callback, s.callback_needed, s.others, s.any_names, s.output) == ([("df", "pandas")], "f", True, ["n"], True, "none")


def pair(spark):
    return frame(spark, [[1, 2], [3, 4], [1, 5]], "a:int,b:int"), frame(spark, [[6, 1], [2, 7]], "c:int,a:int")


@pytest.mark.parametrize("how,rows", [("inner", [[1, 2, 1]]), ("left_outer", [[1, 2, 1], [3, 1, 0]]), ("right_outer", [[1, 2, 1], [7, 0, 1]]), ("full_outer", [[1, 2, 1], [3, 1, 0], [7, 0, 1]])])
def test_cotransform(spark, how, rows):
    def both(x: pd.DataFrame, y: list[dict[str, Any]]) -> list[list[Any]]:
        return [[int(x["a"].iloc[0]) if len(x) else y[0]["a"], len(x), len(y)]]

    check(api.cotransform(api.zip_frames(list(pair(spark)), how), both, "a:int,m:int,n:int"), rows, "a:int,m:int,n:int")
    named = api.zip_frames(dict(zip(("y", "x"), pair(spark)[::-1], strict=True)), how)
    if how in ("inner", "full_outer"):
        check(api.cotransform(named, both, "a:int,m:int,n:int"), rows, "a:int,m:int,n:int")


def test_cotransform_frames(spark):
    def many(dfs: Frames) -> pd.DataFrame:
        return pd.DataFrame({"names": [",".join(dfs)], "n": [sum(map(len, dfs.values()))]})

    a, b = pair(spark)
    check(api.cotransform(api.zip_frames({"p": a, "q": b, "r": a}), many, "names:str,n:int"), [["p,q,r", 5]], "names:str,n:int")
    check(api.cotransform(api.zip_frames([a, b.select("c")], "cross"), many, "names:str,n:int"), [["_0,_1", 5]], "names:str,n:int")
    check(api.cotransform(api.zip_frames([a], partition="a"), many, "names:str,n:int"), [["_0", 2], ["_0", 1]], "names:str,n:int")

    class Both(CoTransformer):
        def get_output_schema(self, schemas):
            return "n:int"

        def transform(self, dfs):
            return pd.DataFrame({"n": [len(dfs)]})

    check(api.cotransform(api.zip_frames([a, b]), Both), [[2]], "n:int")
    for wrong in (lambda: api.zip_frames([a, b], "semi"), lambda: api.zip_frames([a, b], "cross", "a"), lambda: api.zip_frames([a, b.select("c")])):
        with pytest.raises((NotImplementedError, SchemaError)):
            wrong()
    with pytest.raises(SchemaError):
        api.cotransform(api.zip_frames([a, b]), many, "*")


def test_out_cotransform(spark):
    seen = []

    def tell(x: pd.DataFrame, y: pd.DataFrame, say: Callable) -> None:
        say((len(x), len(y)))

    api.out_cotransform(api.zip_frames(list(pair(spark)), "full_outer"), tell, callback=seen.append)
    assert sorted(seen) == [(0, 1), (1, 0), (2, 1)]


def test_runs_of_keys_over_batches(spark):
    """Keys with nulls, NaN and both zeros, of any type, in groups that go over batches: each is called once, in order."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, float(i)) for i in range(40) for k in (0.0, -0.0, None, float("nan"), 2.5)] + [(3.0, None)]
        df = spark.createDataFrame(rows, "k double, v double")

        def whole(df: pd.DataFrame) -> pd.DataFrame:
            assert df.index[0] == 0 and df["v"].dropna().is_monotonic_decreasing
            return pd.DataFrame({"k": df["k"][:1], "n": [len(df)]})

        def lazy(rows: Iterable[list[Any]]) -> Iterable[list[Any]]:
            first = next(iter(rows))
            yield [first[0], 1]  # the rest of the group is left

        spec = {"by": "k", "presort": "v desc"}
        got = {r.k: r.n for r in api.transform(df, whole, "k:double,n:long", partition=spec).collect()}
        assert got == {0.0: 80, None: 80, 2.5: 40, 3.0: 1}
        assert sorted(str(r.k) for r in api.transform(df, lazy, "k:double,n:long", partition=spec).collect()) == ["0.0", "2.5", "3.0", "None"]
        nested = df.selectExpr("named_struct('x', k, 'y', array(k)) AS k", "v").where("v IS NOT NULL AND NOT isnan(k.x) AND k.x > 0")

        def size(t: pa.Table) -> pa.Table:
            return pa.table({"n": pa.array([t.num_rows], pa.int64())})

        assert [r.n for r in api.transform(nested, size, "n:long", partition={"by": "k"}).collect()] == [40]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_frames_of_a_third_library(spark, ab, tmp_path, monkeypatch):
    """Functions annotated with polars frames get these; a stand-in takes the library's place, which need not be there."""
    (tmp_path / "polars").mkdir()
    (tmp_path / "polars" / "__init__.py").write_text("class DataFrame:\n    def __init__(self, t):\n        self.t = t\n    def to_arrow(self):\n        return self.t\n\ndef from_arrow(t):\n    return DataFrame(t)\n")
    if importlib.util.find_spec("polars") is None:
        monkeypatch.syspath_prepend(str(tmp_path))
        spark.sparkContext.addPyFile(shutil.make_archive(str(tmp_path / "stand_in"), "zip", tmp_path, "polars"))
    import polars

    def whole(df: polars.DataFrame) -> polars.DataFrame:
        return df

    def parts(dfs: Iterable[polars.DataFrame]) -> Iterable[polars.DataFrame]:
        yield from dfs

    for fn, kind in ((whole, "polars"), (parts, "polars_iter")):
        assert Signature.read(fn).frames[0][1] == kind and Signature.read(fn).output == kind
        assert sorted(api.transform(ab, fn, "*", partition="a").collect(), key=str) == sorted(ab.collect(), key=str)
