import os

import pytest

from lamina import api
from lamina.operators.output import frame, same


def check(df, rows, schema):
    assert same(df, rows, schema, throw=True)


@pytest.fixture
def ca(spark):
    return frame(spark, [[6, 1], [2, 7]], "c:int,a:long")


def test_parquet(spark, ca, tmp_path):
    path = str(tmp_path / "a.parquet")
    api.save(ca, path)
    check(api.load(spark, path), [[6, 1], [2, 7]], "c:int,a:long")
    check(api.load(spark, path, columns=["a", "c"]), [[1, 6], [7, 2]], "a:long,c:int")
    check(api.load(spark, path, columns="a:str,c:long"), [["1", 6], ["7", 2]], "a:str,c:long")
    api.save(ca, path, mode="append")
    assert api.load(spark, path).count() == 4 and api.load(spark, [path, path]).count() == 8 and api.load(spark, str(tmp_path / "a*.parquet")).count() == 4
    with pytest.raises(Exception, match="already exists"):
        api.save(ca, path, mode="error")
    with pytest.raises(NotImplementedError):
        api.save(ca, path, mode="x")


def test_partitioned(spark, ca, tmp_path):
    path = str(tmp_path / "p")
    api.save(ca, path, "parquet", partition={"by": ["c"], "num": 2})
    assert sorted(d for d in os.listdir(path) if "=" in d) == ["c=2", "c=6"] and api.load(spark, path, "parquet").count() == 2


def test_csv(spark, ca, tmp_path):
    path = str(tmp_path / "a.csv")
    api.save(ca, path, header=True)
    check(api.load(spark, path, header=True), [["6", "1"], ["2", "7"]], "c:str,a:str")
    check(api.load(spark, path, header="true", infer_schema=True), [[6, 1], [2, 7]], "c:int,a:int")
    check(api.load(spark, path, header=True, columns="a:long"), [[1], [7]], "a:long")
    bare = str(tmp_path / "b.csv")
    api.save(ca, bare)
    check(api.load(spark, bare, columns=["x", "y"]), [["6", "1"], ["2", "7"]], "x:str,y:str")
    check(api.load(spark, bare, columns="x:int,y:double"), [[6, 1.0], [2, 7.0]], "x:int,y:double")
    with pytest.raises(ValueError):
        api.load(spark, bare)
    with pytest.raises(ValueError):
        api.load(spark, path, header=True, infer_schema=True, columns="a:int")
    with pytest.raises(NotImplementedError):
        api.load(spark, path, header="x")


def test_json(spark, ca, tmp_path):
    path = str(tmp_path / "a.json")
    api.save(ca, path)
    check(api.load(spark, path, columns=["c", "a"]), [[6, 1], [2, 7]], "c:long,a:long")


def test_single(spark, ca, tmp_path):
    for name, options in (("s.csv", {"header": True}), ("s.parquet", {}), ("s.json", {})):
        path = str(tmp_path / name)
        api.save(ca, path)
        api.save(ca, path, force_single=True, **options)
        assert os.path.isfile(path)
        loaded = api.load(spark, path, **({"header": True} if options else {}))
        assert loaded.count() == 2
        with pytest.raises(FileExistsError):
            api.save(ca, path, force_single=True, mode="error")
        with pytest.raises(NotImplementedError):
            api.save(ca, path, force_single=True, mode="append")


def test_save_and_use(spark, ca, tmp_path):
    for name in ("u.parquet", "u.csv", "u.json"):
        check(api.save_and_use(ca, str(tmp_path / name)), [[6, 1], [2, 7]], "c:int,a:long")


def test_formats(spark, tmp_path):
    for wrong in ("a.xyz", ["a.csv", "a.json"], "a"):
        with pytest.raises(NotImplementedError):
            api.load(spark, wrong)


def test_tables(spark, ca):
    api.save_table(ca, "lamina_test_table")
    assert api.table_exists(spark, "lamina_test_table") and not api.table_exists(spark, "lamina_absent")
    check(api.load_table(spark, "lamina_test_table", ["a"]), [[1], [7]], "a:long")
    spark.sql("DROP TABLE lamina_test_table")
