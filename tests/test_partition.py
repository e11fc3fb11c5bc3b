import pytest
from pyspark.sql import functions as F

from lamina import api
from lamina.operators.partition import PartitionSpec, numbered, partition_spec, repartition
from lamina.operators.relational import parse_presort


def test_specs():
    assert partition_spec(4).num == "4" and partition_spec(["a", "b"]).by == ("a", "b") and partition_spec("a").by == ("a",)
    assert partition_spec("per_row") == PartitionSpec(num="ROWCOUNT", algo="even")
    assert partition_spec('{"by": ["a"], "num": 3}') == PartitionSpec(num="3", by=("a",))
    assert partition_spec(4, by=["a"], presort="b desc, c") == PartitionSpec("4", by=("a",), presort={"b": False, "c": True})
    assert partition_spec(partition_spec(by=["a"]), num=2) == PartitionSpec("2", by=("a",)) and partition_spec().empty
    assert partition_spec(num="min(ROWCOUNT, CONCURRENCY*2)/2").partitions(lambda: 10, 4) == 4


@pytest.mark.parametrize("wrong", [{"by": ["a", "a"]}, {"by": ["a"], "presort": "a"}, {"algo": "x"}, {"num": "__import__('os')"}, {"num": "x"}, {"zz": 1}])
def test_wrong_specs(wrong):
    with pytest.raises(SyntaxError):
        partition_spec(wrong)
    with pytest.raises(TypeError):
        partition_spec(True)


def test_presort():
    assert parse_presort("a, b desc, `c d` ASC") == {"a": True, "b": False, "c d": True} and parse_presort([("a", False), "b"]) == {"a": False, "b": True}
    for wrong in ("a, a", "a up", "a b c"):
        with pytest.raises(SyntaxError):
            parse_presort(wrong)


def sizes(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_repartition(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    assert repartition(df, 5).rdd.getNumPartitions() == 5 and repartition(df, 1).rdd.getNumPartitions() == 1
    assert sizes(repartition(df, {"num": 8, "algo": "even"})) == [12] * 4 + [13] * 4
    assert sizes(repartition(df.limit(6), "per_row")) == [1] * 6
    assert sizes(repartition(df, {"algo": "even", "by": ["k"]})) == [14] * 5 + [15] * 2
    assert repartition(df, {"num": 3, "algo": "rand"}).rdd.getNumPartitions() == 3
    parts = repartition(df, {"num": 3, "by": ["k"], "presort": "id desc"}).withColumn("p", F.spark_partition_id())
    assert parts.groupBy("k").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0
    rows = [(r.p, r.k, -r.id) for r in parts.collect()]
    assert rows == sorted(rows, key=lambda r: (r[0], r[1], r[2])) and repartition(df) is df


def test_even_with_null_keys(spark):
    df = spark.createDataFrame([(1,), (None,), (None,)], "k int")
    assert repartition(df, {"algo": "even", "by": ["k"]}).count() == 3


def test_numbered(spark):
    df = spark.range(50).repartition(4, "id")
    assert sorted(r["__at"] for r in numbered(df).collect()) == list(range(50)) and numbered(df.limit(0)).count() == 0


def test_persist(spark):
    df = spark.range(3)
    assert api.persist(df, level="MEMORY_ONLY").storageLevel.useMemory and api.get_num_partitions(df) >= 1
    with pytest.raises(ValueError):
        api.persist(spark.range(2), level=3)
    with api.session_context(spark) as s:
        assert s is spark and api.get_current_parallelism() == 4
