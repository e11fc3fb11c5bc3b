import subprocess
import sys
import threading
import time

import pandas as pd
import pytest

from lamina import api
from lamina.errors import CompileError, RunError
from lamina.functions import expressions as f
from lamina.functions.expressions import col
from lamina.operators.output import same
from lamina.plans.flow import GLOBAL, UNDETERMINED, Flow, canonical


def build(n=2):
    flow = Flow()
    a = flow.df([[1, 2], [3, 4]], "a:int,b:int")
    return flow, a, a.filter(col("b") > n).assign(c=col("a") + 1)


def test_ids():
    assert build()[0].spec_uuid() == build()[0].spec_uuid() != build(3)[0].spec_uuid()
    flow, a, b = build()
    before = flow.spec_uuid()
    b.persist().broadcast()
    assert flow.spec_uuid() == before and flow.df([[1]], "a:int", data_determiner="x").step.uuid == flow.df([[2]], "a:int", data_determiner="x").step.uuid


def test_run(spark):
    flow, a, b = build()
    b.yield_dataframe_as("out")
    b.yield_dataframe_as("local", as_local=True)
    flow.df([[3, 4, 4]], "a:int,b:int,c:int").assert_eq(b)
    a.assert_not_eq(a.take(1, "a"))
    a.show(2, True, "t")
    result = flow.run(spark)
    assert same(result["out"], [[3, 4, 4]], "a:int,b:int,c:int") and isinstance(result["local"], pd.DataFrame) and "out" in result
    with pytest.raises(CompileError):
        b.yield_dataframe_as("out")
    with pytest.raises(CompileError):
        Flow().add("x", lambda r: None, [b], {})
    with pytest.raises(CompileError):
        Flow(zz=1)


def test_operators(spark):
    flow = Flow()
    a, b = flow.df([[1, 2], [3, 4], [1, None]], "a:int,b:int"), flow.df([[1, "x"]], "a:int,c:str")

    # schema: *,n:int
    def sized(df: pd.DataFrame) -> pd.DataFrame:
        return df.assign(n=len(df))

    def pair(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(x) + len(y)]})

    for frame, rows, schema in (
        (a.inner_join(b), [[1, 2, "x"], [1, None, "x"]], "a:int,b:int,c:str"), (a.semi_join(b)[["a"]].distinct(), [[1]], "a:int"),
        (a.anti_join(b), [[3, 4]], "a:int,b:int"), (a.dropna().union(a.dropna()), [[1, 2], [3, 4]], "a:int,b:int"),
        (a.fillna(9).rename(b="z").alter_columns("z:str"), [[1, "2"], [3, "4"], [1, "9"]], "a:int,z:str"),
        (a.partition_by("a").aggregate(b=f.max("b")), [[1, 2], [3, 4]], "a:int,b:int"), (a.drop(["b"]).select(f.sum("a")), [[5]], "a:long"),
        (a.partition_by("a", presort="b desc").take(1), [[1, 2], [3, 4]], "a:int,b:int"), (a.sample(n=3), [[1, 2], [3, 4], [1, None]], "a:int,b:int"),
        (a.partition_by("a").transform(sized), [[1, 2, 2], [3, 4, 1], [1, None, 2]], "a:int,b:int,n:int"),
        (a.zip(b).transform(pair, "n:int"), [[3]], "n:int"), (a.subtract(a.dropna()), [[1, None]], "a:int,b:int"),
        (a.per_row().repartition(), [[1, 2], [3, 4], [1, None]], "a:int,b:int"), (a.cross_join(b.select(col("c"))).filter(col("a") == 3), [[3, 4, "x"]], "a:int,b:int,c:str"),
    ):
        frame.assert_eq(flow.df(rows, schema))
    flow.run(spark)


def test_extensions(spark):
    flow = Flow()

    @api.creator("a:int")
    def make(n: int) -> list[list[int]]:
        return [[n]]

    def twice(df: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([df, df])

    seen = []
    a = flow.create(make, params={"n": 3})
    b = flow.process(a, using=twice, schema="a:int")
    flow.output(b, using=lambda df: seen.append(df.count()))
    flow.output(b, b, using="assert_eq")
    flow.run(spark)
    assert seen == [2]


def test_checkpoints(spark, tmp_path):
    runs = []

    def count() -> pd.DataFrame:
        runs.append(1)
        return pd.DataFrame({"a": [1]})

    def once(**conf):
        flow = Flow(checkpoint_path=str(tmp_path))
        a = flow.create(count).deterministic_checkpoint(namespace="x")
        a.strong_checkpoint().yield_dataframe_as("out")
        a.yield_file_as("file")
        return flow.run(spark, **conf)

    first = once()
    assert first["out"].count() == 1 and len(runs) == 1 and spark.read.parquet(first["file"]).count() == 1
    assert once()["out"].count() == 1 and len(runs) == 1
    flow = Flow()
    flow.create(count).strong_checkpoint()
    with pytest.raises(RunError):
        flow.run(spark)


def test_tables(spark):
    flow = Flow()
    flow.df([[1]], "a:int").yield_table_as("t")
    name = flow.run(spark)["t"]
    assert spark.table(name).count() == 1
    spark.sql(f"DROP TABLE {name}")


def test_parallel(spark):
    together = threading.Barrier(2, timeout=20)

    def meet(df: pd.DataFrame) -> None:
        together.wait()

    flow = Flow(concurrency=2)
    a = flow.df([[1]], "a:int")
    flow.output(a, using=meet)
    flow.output(a, using=meet)
    began = time.time()
    flow.run(spark)
    assert time.time() - began < 20


def test_auto_persist(spark):
    flow = Flow(auto_persist=True)
    a = flow.df([[1]], "a:int").assign(b=1)
    a.assert_eq(a)
    result = flow.run(spark)
    assert result.frames[a.step].is_cached


def test_compute(spark):
    flow, a, b = build()
    assert b.compute(spark).count() == 1


def test_ids_stand_for_content(spark, tmp_path):
    """Frames that differ deep inside, closures, defaults and globals: another id; equal content: the same."""
    import functools

    import numpy as np
    import pandas as pd
    import pyarrow as pa

    def shifted(by):
        def add(df: pd.DataFrame) -> pd.DataFrame:
            return df.assign(a=df["a"] + by)

        return add

    def with_default(df: pd.DataFrame, by=1) -> pd.DataFrame:
        return df

    first, second = with_default, None
    def with_default(df: pd.DataFrame, by=2) -> pd.DataFrame:  # noqa: F811
        return df

    second = with_default
    long, other = pd.DataFrame({"a": range(1000)}), pd.DataFrame({"a": range(1000)})
    other.loc[500, "a"] = 10**6
    pairs = [
        (long, other), (pa.Table.from_pandas(long), pa.Table.from_pandas(other)), (long["a"].to_numpy(), other["a"].to_numpy()),
        (shifted(1), shifted(2)), (first, second), (functools.partial(first, by=3), functools.partial(first, by=4)), ({1, 2}, {1, 3}), (np.float32(1), np.float32(2)),
        (pd.DataFrame({"a": [{"x": 1}, [2]]}), pd.DataFrame({"a": [{"x": 1}, [3]]})),
    ]
    for a, b in pairs:
        assert canonical(a) != canonical(b) and UNDETERMINED not in canonical(a)
    assert canonical(long) == canonical(long.copy()) and canonical(shifted(1)) == canonical(shifted(1)) and canonical({2, 1}) == canonical({1, 2})
    frame = spark.range(3)
    assert canonical(frame) == canonical(frame) != canonical(spark.range(3)) and UNDETERMINED in canonical([iter([1])])


def test_deterministic_checkpoints_keep_frames_apart(spark, tmp_path):
    import pandas as pd

    long, other = pd.DataFrame({"a": range(1000)}), pd.DataFrame({"a": range(1000)})
    other.loc[500, "a"] = 10**6
    for data, want in ((long, 999), (other, 10**6), (long, 999)):
        flow = Flow(checkpoint_path=str(tmp_path))
        assert flow.df(data, "a:long").deterministic_checkpoint().compute(spark).agg({"a": "max"}).first()[0] == want
    assert len(list((tmp_path / "deterministic").iterdir())) == 2
    flow = Flow(checkpoint_path=str(tmp_path))
    with pytest.raises(CompileError):
        flow.df(spark.range(3)).distinct().deterministic_checkpoint()
    flow.df(spark.range(3), data_determiner="three").deterministic_checkpoint()


def test_strong_checkpoints_go_with_the_run(spark, tmp_path):
    for kind in ("file", "table"):
        flow = Flow(checkpoint_path=str(tmp_path))
        df = flow.df([[1]], "a:int").strong_checkpoint(kind)
        df.assert_eq(flow.df([[1]], "a:int"))
        flow.run(spark)
    assert not [p for p in tmp_path.rglob("*.parquet")] and not [t for t in spark.catalog.listTables() if t.name.startswith("strong_")]
    flow = Flow(checkpoint_path=str(tmp_path))
    assert flow.df([[7]], "a:int").strong_checkpoint().compute(spark).first()[0] == 7


def test_global_conf(spark, tmp_path):
    api.register_global_conf({"checkpoint_path": str(tmp_path)})
    try:
        flow = Flow()
        assert flow.df([[7]], "a:int").strong_checkpoint().compute(spark).first()[0] == 7 and api.get_current_conf()["checkpoint_path"] == str(tmp_path)
        with pytest.raises(CompileError):
            api.register_global_conf({"no_such": 1})
    finally:
        GLOBAL.clear()


def test_a_process_ends_with_results_alive(tmp_path):
    """Nothing that the end of the interpreter runs waits for a JVM that has gone."""
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {str(tmp_path / "warehouse")!r}).getOrCreate()
from lamina.plans.flow import Flow
flow = Flow(checkpoint_path={str(tmp_path)!r}, auto_persist=True)
a = flow.df([[1]], "a:int").strong_checkpoint("table")
a.assert_eq(a.strong_checkpoint())
held = flow.run(spark)
frame = a.compute(spark)
print(frame.count())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=90)
    assert done.stdout.strip() == "1", done.stderr[-2000:]
    assert not list((tmp_path / "warehouse").rglob("*.parquet"))
