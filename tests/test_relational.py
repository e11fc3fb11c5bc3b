import math

import pytest

from lamina import api
from lamina.errors import SchemaError
from lamina.functions import expressions as f
from lamina.functions.expressions import col, function, lit
from lamina.operators.output import frame, same


def check(df, rows, schema):
    assert same(df, rows, schema, throw=True)


@pytest.fixture
def ab(spark):
    return frame(spark, [[1.0, 2], [None, 2], [None, 1], [3.0, 4], [None, 4]], "a:double,b:int")


def test_filter(ab):
    check(api.filter(ab, col("a").not_null() & (col("b") < 3)), [[1.0, 2]], "a:double,b:int")
    check(api.filter(ab, col("a") + col("b") == 3), [[1.0, 2]], "a:double,b:int")
    with pytest.raises(ValueError):
        api.filter(ab, f.max("a") > 1)


def test_select(ab):
    check(api.select(ab, "b", (col("b") + 1).alias("c").cast("str")), [[2, "3"], [2, "3"], [1, "2"], [4, "5"], [4, "5"]], "b:int,c:str")
    check(api.select(ab, "a", lit(5).alias("b"), distinct=True), [[1.0, 5], [None, 5], [3.0, 5]], "a:double,b:int")
    check(api.select(ab, "a", f.sum("b")), [[1.0, 2], [3.0, 4], [None, 7]], "a:double,b:long")
    check(api.select(ab, "a", f.sum("b").alias("s"), having=f.sum("b") > 3), [[3.0, 4], [None, 7]], "a:double,s:long")
    check(api.select(ab, "a", f.sum("b").alias("s"), having=col("s") > 3, where=col("a").not_null()), [[3.0, 4]], "a:double,s:long")
    check(api.select(ab, lit("x", "k"), f.max("b").alias("b"), lit(1, "n")), [["x", 4, 1]], "k:str,b:int,n:int")
    check(api.select(ab, "*", (col("b") * 2).alias("c"), where=col("a") == 1), [[1.0, 2, 4]], "a:double,b:int,c:int")


@pytest.mark.parametrize("columns", [[col("*"), col("*")], [col("*"), f.max("a")], [col("a"), col("a")], [col("a") + 1], []])
def test_select_mistakes(ab, columns):
    with pytest.raises(ValueError):
        api.select(ab, *columns)


def test_expressions(spark):
    df = frame(spark, [[1, None], [4, True]], "x:int,y:bool")
    assert col("x").infer_type(df.schema).simpleString() == "int"
    assert f.max(col("x")).name == "x" and (col("x") + 1).name == "" and (-col("x")).name == "x"
    assert f.is_agg(f.sum("x") + 1) and not f.is_agg(col("x"))
    check(api.select(df, (1 + col("x") * 2 - 1).alias("a"), (8 / col("x")).alias("b"), (~col("y")).alias("c")), [[2, 8.0, None], [8, 2.0, False]], "a:int,b:double,c:bool")
    check(api.select(df, f.coalesce(col("y"), False).alias("a"), (col("y") | True).alias("b")), [[False, True], [True, True]], "a:bool,b:bool")
    check(api.select(df, function("sum", col("x"), arg_distinct=True).alias("s")), [[5]], "s:long")
    check(api.select(df, ((f.min("x") + f.max("x")) / 5).cast("float").alias("s")), [[1.0]], "s:float")
    with pytest.raises(NotImplementedError):
        lit([1])
    with pytest.raises(ValueError):
        bool(col("x") == 1)


def test_assign(ab):
    out = api.assign(ab, b=col("b") * 10, c="x", a=1)
    check(api.filter(out, col("b") == 10), [[1, 10, "x"]], "a:int,b:int,c:str")
    with pytest.raises(ValueError):
        api.assign(ab, x=f.max("a"))


def test_aggregate(ab):
    check(api.aggregate(ab, None, a=f.max("a"), n=f.count("*"), m=f.count("a"), d=f.count_distinct("b")), [[3.0, 5, 2, 3]], "a:double,n:long,m:long,d:long")
    check(api.aggregate(ab, "a", f.max("b"), z=(f.max("b") + f.min("b")) * 2), [[1.0, 2, 8], [3.0, 4, 16], [None, 4, 10]], "a:double,b:int,z:int")
    with pytest.raises(ValueError):
        api.aggregate(ab, "a")
    with pytest.raises(ValueError):
        api.aggregate(ab, "a", x=col("b"))


def test_columns(spark, ab):
    check(api.rename(api.filter(ab, col("a") == 1), {"a": "x"}), [[1.0, 2]], "x:double,b:int")
    for wrong in ({"zz": "a"}, {"a": "b"}):
        with pytest.raises(SchemaError):
            api.rename(ab, wrong)
    assert api.rename(ab, {}) is ab
    with pytest.raises(SchemaError):
        api.drop_columns(ab, ["a", "b"])
    with pytest.raises(SchemaError):
        api.drop_columns(ab, ["c"])
    assert api.drop_columns(ab, ["a", "c"], if_exists=True).columns == ["b"]
    assert api.select_columns(ab, ["b", "a"]).columns == ["b", "a"]
    for wrong in ([], ["zz"]):
        with pytest.raises(SchemaError):
            api.select_columns(ab, wrong)
    odd = frame(spark, [[1, 2, 3]], "`a b`:long,` `:long,_a_b:long")
    out, back = api.normalize_column_names(odd)
    assert all(c.isidentifier() for c in out.columns) and api.rename(out, back).columns == odd.columns


def test_odd_names(spark):
    df = frame(spark, [[0, 1], [2, 3]], "`a b`:long,`x.y`:long")
    check(api.assign(df, **{"x.y": col("x.y") + 1}), [[0, 2], [2, 4]], "`a b`:long,`x.y`:long")
    check(api.take(df, 1, "`a b` desc"), [[2, 3]], "`a b`:long,`x.y`:long")
    check(api.aggregate(df, ["a b"], s=f.sum("x.y")), [[0, 1], [2, 3]], "`a b`:long,s:long")


def test_alter(spark):
    df = frame(spark, [["1", 1.0, True], [None, None, None], ["3", float("inf"), False]], "a:str,b:double,c:bool")
    check(api.alter_columns(df, "a:int,c:str"), [[1, 1.0, "true"], [None, None, None], [3, float("inf"), "false"]], "a:int,b:double,c:str")
    nan = spark.sql("SELECT CAST('NaN' AS DOUBLE) AS x")
    check(api.alter_columns(nan, "x:int"), [[None]], "x:int")
    bools = frame(spark, [["trUe"], ["False"], [None]], "a:str")
    check(api.alter_columns(bools, "a:bool"), [[True], [False], [None]], "a:bool")
    check(api.alter_columns(frame(spark, [["[1,2]"]], "a:str"), "a:[int]"), [[[1, 2]]], "a:[int]")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        api.alter_columns(frame(spark, [["x"]], "a:str"), "a:int").collect()


def test_nulls(spark):
    df = frame(spark, [[4.0, None, 6.0], [1.0, 2.0, 3.0], [4.0, None, None]], "a:double,b:double,c:double")
    assert api.dropna(df).count() == 1 and api.dropna(df, how="all").count() == 3
    assert api.dropna(df, thresh=2).count() == 2 and api.dropna(df, subset=["a", "c"]).count() == 2
    assert api.dropna(df, how="all", subset=["b", "c"]).count() == 2
    check(api.fillna(df, 0), [[4.0, 0.0, 6.0], [1.0, 2.0, 3.0], [4.0, 0.0, 0.0]], "a:double,b:double,c:double")
    check(api.fillna(df, {"b": 0, "c": 9}), [[4.0, 0.0, 6.0], [1.0, 2.0, 3.0], [4.0, 0.0, 9.0]], "a:double,b:double,c:double")
    check(api.fillna(df, 1, ["b"]), [[4.0, 1.0, 6.0], [1.0, 2.0, 3.0], [4.0, 1.0, None]], "a:double,b:double,c:double")
    for wrong in (None, [1], {}, {"b": None}):
        with pytest.raises(ValueError):
            api.fillna(df, wrong)
    assert api.dropna(spark.sql("SELECT CAST('NaN' AS DOUBLE) AS x")).count() == 0


def test_take(spark):
    df = frame(spark, [["a", 2, 3], ["a", 3, 4], ["b", 1, 2], ["b", 2, 2], [None, 4, 2], [None, 2, 1]], "a:str,b:int,c:long")
    schema = "a:str,b:int,c:long"
    check(api.take(df, 1, "b desc"), [[None, 4, 2]], schema)
    check(api.take(df, 1, "a desc, b", na_position="first"), [[None, 2, 1]], schema)
    check(api.take(df, 1, "a desc, b"), [["b", 1, 2]], schema)
    check(api.take(df, 1, "b desc", partition="a"), [["a", 3, 4], ["b", 2, 2], [None, 4, 2]], schema)
    check(api.take(df, 1, partition=api.partition_spec(by=["a"], presort="b")), [["a", 2, 3], ["b", 1, 2], [None, 2, 1]], schema)
    assert api.take(df, 1, partition="a").count() == 3 and api.take(df, 0).count() == 0 and api.take(df, 99).count() == 6
    with pytest.raises(ValueError):
        api.take(df, 0.5)
    with pytest.raises(ValueError):
        api.take(df, 1, "b", na_position="middle")


def test_sample(spark):
    df = spark.range(100)
    assert api.sample(df, n=10, seed=1).count() == 10 and api.sample(df, n=1000).count() == 100
    a, b = (sorted(r.id for r in api.sample(df.coalesce(1), n=10, seed=1).collect()) for _ in range(2))
    assert a == b and len(set(a)) == 10
    assert api.sample(df, n=300, replace=True, seed=2).count() == 300
    assert api.sample(df, n=5, replace=True).schema == df.schema and api.sample(df.limit(0), n=5, replace=True).count() == 0
    assert 0 < api.sample(df, frac=0.5, seed=3).count() < 100
    for wrong in ({}, {"n": 1, "frac": 0.1}, {"frac": 2.0}, {"n": -1}):
        with pytest.raises(ValueError):
            api.sample(df, **wrong)


def test_special_values(spark):
    import pandas as pd

    df = frame(spark, [[float("nan"), pd.NaT], [math.inf, pd.Timestamp("2020-01-02")]], "a:double,b:datetime")
    assert api.as_array(df) == [[None, None], [math.inf, pd.Timestamp("2020-01-02").to_pydatetime()]]
    nested = frame(spark, [[[1, 2], {"x": 1}, {"k": 1}, b"z"]], "a:[int],b:{x:int},c:<str,int>,d:bytes")
    assert api.as_dicts(nested)[0]["a"] == [1, 2] and api.get_schema(nested) == "a:[int],b:{x:int},c:<str,int>,d:bytes"


def test_local_forms(ab):
    assert api.peek_array(api.filter(ab, col("a") == 1)) == [1.0, 2] and api.peek_dict(api.filter(ab, col("a") == 1)) == {"a": 1.0, "b": 2}
    with pytest.raises(ValueError):
        api.peek_array(ab.limit(0))
    assert api.head(ab, 2, ["b"]).num_rows == 2 and len(list(api.as_array_iterable(ab))) == 5 and api.as_pandas(ab).shape == (5, 2)
    assert api.is_df(ab) and not api.is_empty(ab) and api.count(ab) == 5 and api.get_column_names(ab) == ["a", "b"] and api.is_bounded(ab)
    api.assert_eq(ab, ab)
    with pytest.raises(AssertionError):
        api.assert_eq(ab, ab.limit(1))
    api.assert_not_eq(ab, ab.limit(1))


@pytest.mark.parametrize("kind", ["double", "float"])
def test_nan_goes_with_nulls(spark, kind):
    df = spark.createDataFrame([("k", 1.0), ("k", None), ("k", float("nan")), ("k", 5.0)], f"k string, a {kind}")
    for presort, na, want in (("a desc", "last", [5, 1]), ("a", "last", [1, 5]), ("a", "first", [None, None]), ("a desc", "first", [None, None])):
        for by in (None, "k"):
            got = [None if r.a is None or math.isnan(r.a) else r.a for r in api.take(df, 2, presort, na, partition=by).collect()]
            assert sorted(got, key=str) == sorted(want, key=str)


def test_samples_are_of_the_frame(spark):
    df = spark.range(0, 400, numPartitions=7).selectExpr("id", "id * 2 AS twice")
    drawn = [tuple(r) for r in api.sample(df, n=1000, replace=True, seed=3).collect()]
    assert len(drawn) == 1000 and all(0 <= a < 400 and b == 2 * a for a, b in drawn) and 300 < len(set(drawn)) < 400
    behind = df.repartition(5).groupBy("id").count()
    drawn = [r.id for r in api.sample(behind, n=800, replace=True).collect()]
    assert len(drawn) == 800 and set(drawn) <= set(range(400)) and len(set(drawn)) > 250
    once = [r.id for r in api.sample(df, n=100, seed=1).collect()]
    assert len(set(once)) == 100 and set(once) <= set(range(400))
    assert api.sample(df.limit(0), n=5, replace=True).count() == 0


def test_any_names_in_distinct_and_named_arguments(spark):
    df = spark.createDataFrame([(1, "it's"), (1, "a\\b"), (2, "it's")], "`a b` int, `c.d` string")
    got = api.aggregate(df, None, s=function("sum", col("a b"), arg_distinct=True), n=function("count", col("c.d"), arg_distinct=True)).first()
    assert tuple(got) == (3, 2)
    assert api.select(df, function("collect_set", lit("it's \\ `x`"), arg_distinct=True).alias("x")).first().x == ["it's \\ `x`"]
    assert col("a b").sql() == "`a b`" and col("a").sql() == "a"
