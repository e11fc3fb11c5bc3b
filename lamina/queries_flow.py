"""Registered queries of zips, extensions, scripts, checkpoints, placement and streams, with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import api
from .functions import expressions as f
from .functions.expressions import agg_function, col, function, lit
from .operators.extensions import Creator, Processor, Transformer
from .operators.output import frame, same
from .queries import _SUPPLIERS, ORACLE_SQL, QUERIES, _scratch, query, table

# Zips of every kind


def _pair_sizes(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    held = a if len(a) else b
    return pd.DataFrame({"k": held["k"][:1].astype("int32"), "m": [len(a)], "n": [len(b)]})


def _zip(how: str):
    def run(spark, sf_dir):
        a = api.select(table(spark, sf_dir, "customer"), col("c_nationkey", "k"), "c_custkey", where=col("c_nationkey") > 3)
        b = api.select(table(spark, sf_dir, "supplier"), col("s_nationkey", "k"), "s_suppkey", where=col("s_nationkey") < 20)
        return api.cotransform(api.zip_frames([a, b], how, "k"), _pair_sizes, "k:int,m:long,n:long")

    return run


_SIZES = "(SELECT c_nationkey AS k, count(*) AS m FROM customer WHERE c_nationkey > 3 GROUP BY 1) a {} JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey < 20 GROUP BY 1) b ON a.k = b.k"
for _how, _join in (("inner", "INNER"), ("left_outer", "LEFT"), ("right_outer", "RIGHT"), ("full_outer", "FULL")):
    QUERIES[f"zip_{_how}"] = _zip(_how)
    ORACLE_SQL[f"zip_{_how}"] = f"SELECT coalesce(a.k, b.k) AS k, coalesce(m, 0) AS m, coalesce(n, 0) AS n FROM {_SIZES.format(_join)}"


def _all_sizes(a: pd.DataFrame, b: pa.Table) -> list[list[Any]]:
    return [[len(a), b.num_rows, int(a["r_regionkey"].sum())]]


@query("SELECT (SELECT count(*) FROM region) AS m, (SELECT count(*) FROM nation) AS n, (SELECT CAST(sum(r_regionkey) AS BIGINT) FROM region) AS s")
def zip_cross(spark, sf_dir):
    return api.cotransform(api.zip_frames([table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")], "cross"), _all_sizes, "m:long,n:long,s:long")


# Extensions as classes, by name and by decorator


class _Ranked(Transformer):
    """Numbers the rows of each key, from a start that on_init sets."""

    def get_output_schema(self, schema):
        return "*,no:long,key:str"

    def on_init(self, schema):
        self.start = self.params["start"]

    def transform(self, df):
        return df.assign(no=range(self.start, self.start + len(df)), key=str(self.cursor.key_value_array[0]))


@query("SELECT n_nationkey, n_regionkey, 9 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS no, CAST(n_regionkey AS VARCHAR) AS key FROM nation")
def transform_class(spark, sf_dir):
    rows = api.select_columns(table(spark, sf_dir, "nation"), ["n_nationkey", "n_regionkey"])
    return api.transform(rows, _Ranked, partition={"by": "n_regionkey", "presort": "n_nationkey desc"}, params={"start": 10})


class _Numbers(Creator):
    def create(self):
        return self.session.range(self.params["n"]).selectExpr("CAST(id AS INT) AS k")


class _Within(Processor):
    def process(self, dfs):
        return api.semi_join(dfs[0], dfs[1])


@query("SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey < 7")
def flow_extensions(spark, sf_dir):
    flow = api.Flow()
    nations = flow.load(f"{sf_dir}/nation.parquet").rename(n_nationkey="k")[["k", "n_name"]]
    nations.process(flow.create(_Numbers, params={"n": 7}), using=_Within).yield_dataframe_as("out")
    return flow.run(spark)["out"]


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) <= 12")
def transform_ignoring_errors(spark, sf_dir):
    """A group whose function fails gives no rows, and the others all theirs."""
    rows = api.select_columns(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"])
    return api.transform(rows, _few, "o_custkey:long,n:long", partition="o_custkey", ignore_errors=[OverflowError])


def _few(df: pd.DataFrame) -> pd.DataFrame:
    if len(df) > 12:
        raise OverflowError(f"{len(df)} rows")
    return pd.DataFrame({"o_custkey": df["o_custkey"][:1], "n": [len(df)]})


def _grouped(df: pd.DataFrame) -> pd.DataFrame:
    return df.groupby("p_size", as_index=False).agg(n=("p_partkey", "size"))


@query("SELECT p_size, count(*) AS n FROM part GROUP BY 1")
def transform_coarse(spark, sf_dir):
    """Coarse placement keeps the rows of a key in one partition, which is given whole."""
    rows = api.select_columns(table(spark, sf_dir, "part"), ["p_partkey", "p_size"])
    return api.transform(rows, _grouped, "p_size:int,n:long", partition={"by": "p_size", "algo": "coarse", "num": 4})


@query("SELECT count(*) AS good, 0 AS bad FROM (SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4)")
def validation_rules(spark, sf_dir):
    """Functions that ask for keys, an order or columns refuse calls without them."""
    rows = table(spark, sf_dir, "nation")
    ruled = api.transformer("*", partitionby_has="n_regionkey", presort_is="n_nationkey desc", input_has="n_name")(_same)
    fine = {"by": ["n_regionkey"], "presort": "n_nationkey desc"}
    good = api.transform(rows, ruled, partition=fine).count() == rows.count()
    refused = 0
    for df, spec in ((rows, None), (rows, "n_regionkey"), (rows.drop("n_name"), fine)):
        try:
            api.transform(df, ruled, partition=spec)
        except Exception as e:
            refused += type(e).__name__ == "ValidationError"
    return spark.createDataFrame([(int(good) + refused, 4 - int(good) - refused)], "good long, bad int")


def _same(df: pd.DataFrame) -> pd.DataFrame:
    return df


# Statements of scripts


def _keep(a: DataFrame, b: DataFrame) -> DataFrame:
    return api.inner_join(a, b)


def _count_rows(df: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"n": [len(df)]})


def _assert_sizes(a: DataFrame, b: DataFrame) -> None:
    assert a.count() >= b.count()


_SCOPE = {"_pair_sizes": _pair_sizes, "_keep": _keep, "_count_rows": _count_rows, "_assert_sizes": _assert_sizes}


def _script(text: str, *names: str):
    def run(spark, sf_dir):
        filled = text.replace("@IN", sf_dir).replace("@OUT", _scratch(spark, "script"))
        return api.xsql(filled, {n: table(spark, sf_dir, n) for n in names}, spark=spark, scope=_SCOPE)

    return run


for _name, _text, _sql, *_tables in (
    ("xsql_load", "x = LOAD '@IN/nation.parquet' COLUMNS n_nationkey, n_name SELECT n_name FROM x WHERE n_nationkey < 5", "SELECT n_name FROM nation WHERE n_nationkey < 5"),
    ("xsql_save", "SAVE supplier OVERWRITE parquet '@OUT/s' LOAD parquet '@OUT/s' COLUMNS s_suppkey, s_name", "SELECT s_suppkey, s_name FROM supplier", "supplier"),
    ("xsql_save_and_use", "x = SAVE AND USE supplier OVERWRITE SINGLE csv '@OUT/s.csv'(header=True) SELECT s_nationkey, count(*) AS n FROM x GROUP BY s_nationkey", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1", "supplier"),
    ("xsql_append", "SAVE supplier OVERWRITE parquet '@OUT/s' SAVE supplier APPEND parquet '@OUT/s' LOAD parquet '@OUT/s' SELECT s_suppkey, count(*) AS n GROUP BY s_suppkey", "SELECT s_suppkey, 2 * count(*) AS n FROM supplier GROUP BY 1", "supplier"),
    ("xsql_zip", "a = SELECT c_nationkey AS k, c_custkey FROM customer WHERE c_nationkey > 3 b = SELECT s_nationkey AS k, s_suppkey FROM supplier WHERE s_nationkey < 20 ZIP a, b LEFT OUTER BY k TRANSFORM USING _pair_sizes SCHEMA k:int,m:long,n:long", f"SELECT a.k, m, coalesce(n, 0) AS n FROM {_SIZES.format('LEFT')}", "customer", "supplier"),
    ("xsql_process", "a = SELECT n_regionkey AS r_regionkey, n_name FROM nation PROCESS a, region USING _keep", "SELECT n_regionkey AS r_regionkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", "region"),
    ("xsql_output", "OUTPUT nation, region USING _assert_sizes PRINT 2 ROWS FROM region ROWCOUNT TITLE 'regions' SELECT r_name FROM region", "SELECT r_name FROM region", "nation", "region"),
    ("xsql_assert", "x = SELECT r_regionkey FROM region y = SELECT r_regionkey FROM region WHERE r_regionkey >= 0 OUTPUT x, y USING assert_eq OUTPUT x, region USING assert_not_eq SELECT count(*) AS n FROM y", "SELECT count(*) AS n FROM region", "region"),
    ("xsql_keyed_count", "TRANSFORM nation PREPARTITION BY n_regionkey USING _count_rows SCHEMA n:long", "SELECT count(*) AS n FROM nation GROUP BY n_regionkey", "nation"),
    ("xsql_sample_share", "x = SAMPLE 100 PERCENT SEED 3 FROM nation SELECT n_name FROM x", "SELECT n_name FROM nation", "nation"),
    ("xsql_checkpoint", "x = SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey PERSIST SELECT x.n, r_name FROM x INNER JOIN region ON n_regionkey = r_regionkey", "SELECT count(*) AS n, r_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "nation", "region"),
):
    QUERIES[_name] = _script(_text, *_tables)
    ORACLE_SQL[_name] = _sql


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def sql_of_frames(spark, sf_dir):
    return api.raw_sql("SELECT n_name, r_name FROM", table(spark, sf_dir, "nation"), "AS n JOIN", table(spark, sf_dir, "region"), "AS r ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def xsql_catalog_table(spark, sf_dir):
    """A script reads a catalog table by its name."""
    name = f"lamina_{uuid.uuid4().hex}"
    api.save_table(table(spark, sf_dir, "nation"), name)
    return api.xsql(f"SELECT n_regionkey, count(*) AS n FROM {name} GROUP BY n_regionkey", spark=spark)


# Checkpoints and yields


@query("SELECT * FROM (VALUES (999::BIGINT, 'first'), (1000000::BIGINT, 'second'), (999::BIGINT, 'third')) t(most, run)")
def flow_checkpoint_ids(spark, sf_dir):
    """Two frames that differ in one row, and one of them again, through deterministic checkpoints in one folder."""
    where, out = _scratch(spark, "deterministic"), []
    for name, high in (("first", 500), ("second", 1_000_000), ("third", 500)):
        data = pd.DataFrame({"a": range(1000)})
        data.loc[500, "a"] = high
        flow = api.Flow(checkpoint_path=where)
        kept = flow.df(data, "a:long").deterministic_checkpoint().compute(spark)
        out.append((kept.agg(F.max("a")).first()[0], name))
    return spark.createDataFrame(out, "most long, run string")


@query("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1")
def flow_strong_checkpoint(spark, sf_dir):
    flow = api.Flow(checkpoint_path=_scratch(spark, "strong"))
    suppliers = flow.load(f"{sf_dir}/supplier.parquet").persist().strong_checkpoint()
    return suppliers.partition_by("s_nationkey").aggregate(n=f.count("*")).strong_checkpoint("table").compute(spark)


@query(_SUPPLIERS)
def flow_yield_file(spark, sf_dir):
    flow = api.Flow(checkpoint_path=_scratch(spark, "yields"))
    flow.load(f"{sf_dir}/supplier.parquet").yield_file_as("x")
    return api.load(spark, flow.run(spark)["x"], "parquet")


@query(_SUPPLIERS)
def flow_yield_table(spark, sf_dir):
    flow = api.Flow()
    flow.load(f"{sf_dir}/supplier.parquet").yield_table_as("x")
    return api.load_table(spark, flow.run(spark)["x"])


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def flow_side_by_side(spark, sf_dir):
    """Ends of a pipeline run at the same time; a shared step runs once, and settings come from the global ones."""
    flow = api.Flow(concurrency=3, auto_persist=True)
    nations, regions = flow.load(f"{sf_dir}/nation.parquet").rename(n_regionkey="r_regionkey"), flow.load(f"{sf_dir}/region.parquet")
    both = nations.inner_join(regions)
    both.assert_eq(both)
    both.partition_by("r_name").aggregate(n=f.count("*")).yield_dataframe_as("out")
    both.save(_scratch(spark, "side.parquet"))
    return flow.run(spark)["out"]


# Files, names and local forms


@query(f"SELECT s_suppkey, 3 AS n, true AS refused FROM ({_SUPPLIERS})")
def io_modes(spark, sf_dir):
    rows, path = table(spark, sf_dir, "supplier"), _scratch(spark, "modes.parquet")
    for mode in ("error", "overwrite", "append", "append"):
        if mode == "overwrite":
            try:
                api.save(rows, path, mode="error")
                refused = False
            except Exception:
                refused = True
        api.save(rows, path, mode=mode)
    counted = api.load(spark, path).groupBy("s_suppkey").agg(F.count("*").cast("int").alias("n"))
    return counted.withColumn("refused", F.lit(refused))


@query("SELECT * FROM (VALUES ('a_b', 1), ('_2', 2), ('c', 3)) t(name, no)")
def normalized_names(spark, sf_dir):
    odd = frame(spark, [[1, 2, 3]], "`a b`:int,`2`:int,c:int")
    names = api.normalize_column_names(odd)
    found = (names[0] if isinstance(names, tuple) else names).columns
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(found)], "name string, no int")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 4")
def local_forms(spark, sf_dir):
    """The same rows by head, arrays, dicts and peeks, back as a frame."""
    rows = api.take(api.select_columns(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name"]), 4, "n_nationkey").coalesce(1).sortWithinPartitions("n_nationkey")
    forms = [api.as_array(rows), [list(d.values()) for d in api.as_dicts(rows)], [list(r) for r in api.head(rows, 4).to_pandas().values.tolist()], [list(r) for r in api.as_array_iterable(rows)]]
    assert all(x == forms[0] for x in forms) and api.peek_array(rows) == forms[0][0] and list(api.peek_dict(rows).values()) == forms[0][0]
    assert same(rows, forms[0], "n_nationkey:int,n_name:str") and api.as_local_bounded(rows).num_rows == 4 == api.count(rows)
    return frame(spark, forms[0], "n_nationkey:int,n_name:str")


@query("SELECT * FROM (VALUES ('n_nationkey:int,n_name:str,n_regionkey:int', 3, false, true)) t(schema, columns, empty, bounded)")
def introspection(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    return spark.createDataFrame([(api.get_schema(df), len(api.get_column_names(df)), api.is_empty(df), api.is_bounded(df))], "schema string, columns int, empty boolean, bounded boolean")


# Aggregates, rows of keys, samples, and set operations by name


@query("SELECT o_custkey, min(o_orderkey) AS lone, max(o_orderkey) AS also, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) = 1")
def aggregate_first_of_one(spark, sf_dir):
    """FIRST and LAST where a group has one row, so that both are told."""
    found = api.aggregate(table(spark, sf_dir, "orders"), "o_custkey", lone=f.first("o_orderkey"), also=f.last("o_orderkey"), n=f.count("*"))
    return api.filter(found, col("n") == 1)


@query("SELECT l_returnflag, round(sum(DISTINCT l_quantity), 2) AS s, count(DISTINCT l_linenumber) AS n, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def aggregate_by_name(spark, sf_dir):
    return api.aggregate(table(spark, sf_dir, "lineitem"), "l_returnflag", s=function("round", agg_function("sum", col("l_quantity"), arg_distinct=True), lit(2)), n=f.count_distinct("l_linenumber"), most=agg_function("max", col("l_quantity")))


@query("SELECT count(DISTINCT o_custkey) AS keys, count(DISTINCT o_custkey) AS of_the_table FROM orders")
def take_one_per_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    one = api.take(orders, 1, partition="o_custkey")
    kept = one.join(orders, orders.columns, "left_semi")
    return one.agg(F.count_distinct("o_custkey").alias("keys")).crossJoin(kept.agg(F.count("*").alias("of_the_table")))


@query("SELECT * FROM (VALUES (1.0::DOUBLE, 'first'), (5.0::DOUBLE, 'first'), (5.0::DOUBLE, 'last'), (NULL, 'low')) t(a, what)")
def take_nulls_and_nan(spark, sf_dir):
    """NaN goes with nulls, first or last whatever the direction."""
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (5.0,)], "a double")
    parts = [("first", api.take(df, 2, "a")), ("last", api.take(df, 1, "a desc")), ("low", api.take(df, 1, "a desc", na_position="first"))]
    out = None
    for name, part in parts:
        part = part.select(F.nanvl("a", F.lit(None)).alias("a"), F.lit(name).alias("what"))
        out = part if out is None else out.union(part)
    return out


@query("SELECT 300 AS rows, 300 AS distinct_rows, 300 AS of_the_table")
def sample_members(spark, sf_dir):
    return _members(api.sample(table(spark, sf_dir, "orders"), n=300, seed=5), table(spark, sf_dir, "orders"), "count_distinct")


@query("SELECT 900 AS rows, 1 AS distinct_rows, 900 AS of_the_table")
def sample_replace_members(spark, sf_dir):
    """Drawn with replacement out of 25 rows: more draws than rows, all of them of the table (and some twice)."""
    return _members(api.sample(table(spark, sf_dir, "nation"), n=900, replace=True, seed=5), table(spark, sf_dir, "nation"), "repeats")


def _members(drawn: DataFrame, rows: DataFrame, what: str) -> DataFrame:
    drawn = drawn.checkpoint() if drawn.sparkSession.sparkContext.getCheckpointDir() else drawn.persist()
    within = drawn.join(rows, rows.columns, "left_semi")
    distinct = F.count_distinct(F.struct(*drawn.columns))
    told = distinct if what == "count_distinct" else (distinct <= rows.count()).cast("int")
    return drawn.agg(F.count("*").cast("int").alias("rows"), told.cast("int").alias("distinct_rows")).crossJoin(within.agg(F.count("*").cast("int").alias("of_the_table")))


@query("SELECT true AS near, 0 AS strangers")
def sample_share_members(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    drawn = api.sample(rows, frac=0.2, seed=4)
    strangers = drawn.join(rows, ["l_orderkey", "l_linenumber"], "left_anti")
    total = rows.count()
    bound = 5 * (0.16 * total) ** 0.5
    return drawn.agg((F.abs(F.count("*") - 0.2 * total) < bound).alias("near")).crossJoin(strangers.agg(F.count("*").cast("int").alias("strangers")))


for _how, _sql in (("union", "UNION"), ("subtract", "EXCEPT"), ("intersect", "INTERSECT")):
    QUERIES[f"set_op_{_how}"] = lambda spark, sf_dir, how=_how: api.set_op(how, api.select(table(spark, sf_dir, "customer"), col("c_nationkey", "k"), where=col("c_nationkey") > 4), api.select(table(spark, sf_dir, "supplier"), col("s_nationkey", "k"), where=col("s_nationkey") < 20))
    ORACLE_SQL[f"set_op_{_how}"] = f"SELECT c_nationkey AS k FROM customer WHERE c_nationkey > 4 {_sql} SELECT s_nationkey FROM supplier WHERE s_nationkey < 20"


# Placement


@query("SELECT 3 AS parts, 0 AS split_keys, count(*) AS n FROM orders")
def repartition_hash(spark, sf_dir):
    """Rows of a key share a partition, and presort orders them there."""
    rows = api.repartition(api.select_columns(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"]), {"num": 3, "by": ["o_custkey"], "algo": "hash", "presort": "o_orderkey desc"})
    placed = rows.withColumn("p", F.spark_partition_id())
    split = placed.groupBy("o_custkey").agg(F.count_distinct("p").alias("parts")).agg(F.sum((F.col("parts") > 1).cast("int")).cast("int").alias("split_keys"))
    return placed.agg(F.count_distinct("p").cast("int").alias("parts"), F.count("*").alias("n")).crossJoin(split)


@query("SELECT 5 AS parts, count(*) AS n, true AS even FROM orders")
def repartition_rand(spark, sf_dir):
    rows = api.repartition(api.select_columns(table(spark, sf_dir, "orders"), ["o_orderkey"]), {"num": 5, "algo": "rand"})
    sizes = rows.groupBy(F.spark_partition_id().alias("p")).count()
    n = F.sum("count")
    return sizes.agg(F.count("*").cast("int").alias("parts"), n.alias("n"), (F.max("count") < 0.4 * n).alias("even"))


@query("SELECT 40 AS parts, 40 AS rows")
def repartition_per_row(spark, sf_dir):
    rows = api.repartition(api.take(table(spark, sf_dir, "customer"), 40, "c_custkey"), "per_row")
    return rows.groupBy(F.spark_partition_id().alias("p")).count().agg(F.count("*").cast("int").alias("parts"), F.sum("count").cast("int").alias("rows"))


@query("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1")
def persisted(spark, sf_dir):
    return api.aggregate(api.persist(table(spark, sf_dir, "supplier"), level="MEMORY_AND_DISK"), "s_nationkey", n=f.count("*"))


# Streams and windows of time


_HOURS = "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL"


@query(_HOURS)
def windows_bounded(spark, sf_dir):
    return api.windowed(table(spark, sf_dir, "events"), "ts", "1 hour", by=["event_type"], n=f.count("*"), most=f.max("value"))


@query(_HOURS)
def windows_streamed(spark, sf_dir):
    """The same from a stream of the table, with a watermark: a finished run has emitted every window."""
    name = f"lamina_{uuid.uuid4().hex}"
    whole = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(whole.schema).parquet(f"{sf_dir}/events.parquet*")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    run = api.windowed(stream, "ts", "1 hour", late="10 minutes", by=["event_type"], n=f.count("*"), most=f.max("value")).writeStream
    run = run.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", _scratch(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    utc = {c: F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss")) for c in ("window_start", "window_end")}
    return spark.table(name).withColumns(utc)


@query("""WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  placed AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM marked)
  SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n FROM placed GROUP BY user_id, no""")
def windows_of_sessions(spark, sf_dir):
    return api.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", by=["user_id"], n=f.count("*"))


def _tell(x: pd.DataFrame, y: pd.DataFrame, say: Callable) -> None:
    held = x if len(x) else y
    say(int(held["k"].iloc[0]), len(x) + len(y))


@query(f"SELECT coalesce(a.k, b.k) AS k, coalesce(m, 0) + coalesce(n, 0) AS n FROM {_SIZES.format('FULL')}")
def zip_callback(spark, sf_dir):
    """Workers tell the driver the sizes of each key's frames; a repeated task says the same again."""
    told: dict[int, int] = {}
    a = api.select(table(spark, sf_dir, "customer"), col("c_nationkey", "k"), "c_custkey", where=col("c_nationkey") > 3)
    b = api.select(table(spark, sf_dir, "supplier"), col("s_nationkey", "k"), "s_suppkey", where=col("s_nationkey") < 20)
    api.out_cotransform(api.zip_frames([a, b], "full_outer", "k"), _tell, callback=told.__setitem__)
    return frame(spark, sorted(map(list, told.items())), "k:int,n:long")
