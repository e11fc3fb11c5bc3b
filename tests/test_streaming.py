from collections.abc import Iterable

import pandas as pd

from lamina import api
from lamina.functions import expressions as f
from lamina.streaming.windows import sessions, windowed

SF = "/root/testdata/sf0.001/events.parquet"


def test_windows(spark):
    events = spark.read.parquet(SF).withColumn("ts", api.function("to_timestamp", api.col("ts")).column())
    got = windowed(events, "ts", "1 hour", by=["event_type"], n=f.count("*"), v=f.max("value"))
    assert got.columns == ["window_start", "window_end", "event_type", "n", "v"] and sum(r.n for r in got.collect()) == events.count()
    assert sum(r.n for r in sessions(events, "ts", "10 minutes", by=["user_id"], n=f.count("*")).collect()) == events.count()


def test_stream(spark, tmp_path):
    events = spark.read.parquet(SF).selectExpr("event_id", "cast(ts AS timestamp) AS ts", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def double(dfs: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for df in dfs:
            yield df.assign(value=df["value"] * 2)

    assert not api.is_bounded(stream)
    doubled = windowed(api.transform(stream, double, "*"), "ts", "1 day", n=f.count("*"), v=f.sum("value"))
    query = doubled.writeStream.outputMode("complete").format("memory").queryName("lamina_windows").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("lamina_windows").collect()
    assert sum(r.n for r in got) == 1000 and abs(sum(r.v for r in got) - 2 * events.agg({"value": "sum"}).first()[0]) < 1e-3
