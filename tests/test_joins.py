import random

import pandas as pd
import pytest

from lamina import api
from lamina.errors import SchemaError
from lamina.operators.joins import join_keys, join_kind
from lamina.operators.output import frame, same


def check(df, rows, schema):
    assert same(df, rows, schema, throw=True)


def test_kinds():
    assert join_kind("LEFT outer") == "left_outer" and join_kind("semi") == "left_semi"
    for wrong in ("outer", "x"):
        with pytest.raises(ValueError):
            join_kind(wrong)


def test_keys():
    assert join_keys(["a", "b", "c"], ["c", "a", "x"], "inner", ["c", "a"]) == ["a", "c"]
    assert join_keys(["a", "b"], ["a", "b"], "left_semi", ["b"]) == ["b"]
    for left, right, kind, on in (["a"], ["b"], "inner", None), (["a", "b"], ["a", "b"], "inner", ["a"]), (["a"], ["a"], "cross", None), (["a"], ["b"], "cross", ["a"]), (["a"], ["a"], "inner", ["a", "a"]):
        with pytest.raises(SchemaError):
            join_keys(left, right, kind, on)


def test_joins(spark):
    a, b = frame(spark, [[1, "2"], [3, "4"]], "a:int,b:str"), frame(spark, [["6", 1], ["2", 7]], "c:str,a:int")
    check(api.inner_join(a, b), [[1, "2", "6"]], "a:int,b:str,c:str")
    check(api.left_outer_join(a, b), [[1, "2", "6"], [3, "4", None]], "a:int,b:str,c:str")
    check(api.right_outer_join(a, b), [[1, "2", "6"], [7, None, "2"]], "a:int,b:str,c:str")
    check(api.full_outer_join(a, b), [[1, "2", "6"], [3, "4", None], [7, None, "2"]], "a:int,b:str,c:str")
    check(api.semi_join(a, b), [[1, "2"]], "a:int,b:str")
    check(api.anti_join(a, b), [[3, "4"]], "a:int,b:str")
    check(api.cross_join(a, frame(spark, [[9]], "z:int")), [[1, "2", 9], [3, "4", 9]], "a:int,b:str,z:int")
    empty = frame(spark, [], "c:str,a:int")
    check(api.left_outer_join(a, empty), [[1, "2", None], [3, "4", None]], "a:int,b:str,c:str")
    check(api.inner_join(a, b, frame(spark, [[1, 5]], "a:int,d:int")), [[1, "2", "6", 5]], "a:int,b:str,c:str,d:int")
    check(api.inner_join(a, api.broadcast(b)), [[1, "2", "6"]], "a:int,b:str,c:str")


def test_null_keys(spark):
    a, b = frame(spark, [[1.0, 2.0, 3], [4.0, None, 6]], "a:double,b:double,c:int"), frame(spark, [[1.0, 2.0, 33], [4.0, None, 63]], "a:double,b:double,d:int")
    check(api.inner_join(a, b), [[1.0, 2.0, 3, 33]], "a:double,b:double,c:int,d:int")
    check(api.anti_join(a, b), [[4.0, None, 6]], "a:double,b:double,c:int")


def test_sets(spark):
    schema = "a:double,b:double,c:int"
    a = frame(spark, [[1.0, 2.0, 3], [4.0, None, 6], [4.0, None, 6]], schema)
    b = frame(spark, [[1.0, 2.0, 33], [4.0, None, 6]], schema)
    check(api.union(a, b), [[1.0, 2.0, 3], [4.0, None, 6], [1.0, 2.0, 33]], schema)
    assert api.union(a, b, distinct=False).count() == 5
    check(api.subtract(a, b), [[1.0, 2.0, 3]], schema)
    check(api.subtract(a, b, distinct=False), [[1.0, 2.0, 3], [4.0, None, 6]], schema)
    check(api.intersect(a, b), [[4.0, None, 6]], schema)
    check(api.intersect(a, a, distinct=False), [[1.0, 2.0, 3], [4.0, None, 6], [4.0, None, 6]], schema)
    with pytest.raises(SchemaError):
        api.union(a, frame(spark, [[1.0, 2.0, 3]], "a:double,b:double,d:int"))
    with pytest.raises(ValueError):
        api.set_op("x", a, b)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_random_against_pandas(spark, how):
    rng = random.Random(how)
    left = pd.DataFrame({"k": [rng.randrange(8) for _ in range(30)], "x": range(30)})
    right = pd.DataFrame({"k": [rng.randrange(3, 12) for _ in range(20)], "y": range(20)})
    want = left.merge(right, on="k", how=how)
    got = api.join(spark.createDataFrame(left), spark.createDataFrame(right), how="full" if how == "outer" else how).toPandas()
    tidy = lambda d: sorted(map(tuple, d[["k", "x", "y"]].fillna(-1).astype(int).values.tolist()))
    assert tidy(got) == tidy(want)
