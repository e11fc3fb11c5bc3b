"""The registered queries of the relational layer and their SQL twins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import expressions as f
from .functions.expressions import agg_function, col, function, lit
from .operators.output import frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 4) AS sum_qty,
  ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue, COUNT(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(revenue, 4).alias("revenue"), F.count("*").alias("n"))


# Projection, filter and schema operators


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 45 AND l_returnflag <> 'N'")
def select_where(spark, sf_dir):
    net = (col("l_extendedprice") * (1 - col("l_discount"))).alias("net")
    return api.select(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", net, where=(col("l_quantity") > 45) & (col("l_returnflag") != "N"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(spark, sf_dir):
    return api.select(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", distinct=True)


@query("SELECT *, o_totalprice / 2 AS half FROM orders WHERE o_orderstatus = 'F'")
def select_wildcard(spark, sf_dir):
    return api.select(table(spark, sf_dir, "orders"), "*", (col("o_totalprice") / 2).alias("half"), where=col("o_orderstatus") == "F")


@query("SELECT * FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
def filter_rows(spark, sf_dir):
    return api.filter(table(spark, sf_dir, "customer"), (col("c_acctbal") < 0) | (col("c_mktsegment") == "BUILDING"))


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size + 1 AS p_size, p_retailprice, 'x' AS tag, p_retailprice * 2 AS twice FROM part")
def assign_columns(spark, sf_dir):
    return api.assign(table(spark, sf_dir, "part"), p_size=col("p_size") + 1, tag="x", twice=col("p_retailprice") * 2)


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")
def rename_columns(spark, sf_dir):
    return api.rename(table(spark, sf_dir, "nation"), {"n_nationkey": "id", "n_name": "name"})


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def alter_columns(spark, sf_dir):
    return api.alter_columns(table(spark, sf_dir, "supplier"), "s_suppkey:str,s_nationkey:long")


@query("SELECT event_id, user_id, event_type, value FROM events")
def drop_columns(spark, sf_dir):
    return api.drop_columns(table(spark, sf_dir, "events"), ["ts", "props", "absent"], if_exists=True)


@query("SELECT o_totalprice, o_orderkey FROM orders")
def select_columns(spark, sf_dir):
    return api.select_columns(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"])


@query("SELECT r_regionkey AS k, r_name FROM region UNION ALL SELECT 99, 'none'")
def create_data(spark, sf_dir):
    regions = api.rename(table(spark, sf_dir, "region"), {"r_regionkey": "k"})
    return api.union(regions, frame(spark, [[99, "none"]], "k:int,r_name:str"), distinct=False)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def load_columns(spark, sf_dir):
    return api.load(spark, f"{sf_dir}/orders.parquet", columns=["o_orderkey", "o_totalprice"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def load_schema(spark, sf_dir):
    return api.load(spark, f"{sf_dir}/customer.parquet", columns="c_custkey:str,c_nationkey:long")


# Joins


def _nations(spark, sf_dir):
    return api.select(table(spark, sf_dir, "nation"), col("n_nationkey", "nationkey"), "n_name", col("n_regionkey", "regionkey"))


def _customers(spark, sf_dir):
    return api.select(table(spark, sf_dir, "customer"), col("c_custkey", "custkey"), col("c_nationkey", "nationkey"), "c_acctbal")


def _orders(spark, sf_dir):
    return api.select(table(spark, sf_dir, "orders"), col("o_orderkey", "orderkey"), col("o_custkey", "custkey"), "o_totalprice", where=col("o_totalprice") > 150000)


@query("SELECT c_custkey AS custkey, c_nationkey AS nationkey, c_acctbal, n_name, n_regionkey AS regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def inner_join(spark, sf_dir):
    return api.inner_join(_customers(spark, sf_dir), _nations(spark, sf_dir))


@query("SELECT c_custkey AS custkey, c_nationkey AS nationkey, c_acctbal, o_orderkey AS orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) ON c_custkey = o_custkey")
def left_join(spark, sf_dir):
    return api.left_outer_join(_customers(spark, sf_dir), _orders(spark, sf_dir))


@query("SELECT o_orderkey AS orderkey, c_custkey AS custkey, o_totalprice, c_nationkey AS nationkey, c_acctbal FROM (SELECT * FROM orders WHERE o_totalprice > 150000) RIGHT JOIN customer ON c_custkey = o_custkey")
def right_join(spark, sf_dir):
    return api.right_outer_join(_orders(spark, sf_dir), _customers(spark, sf_dir))


@query("SELECT coalesce(o_custkey, c_custkey) AS custkey, o_orderkey AS orderkey, c_acctbal FROM (SELECT * FROM orders WHERE o_totalprice > 150000) FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def full_join(spark, sf_dir):
    rich = api.select(_customers(spark, sf_dir), "custkey", "c_acctbal", where=col("c_acctbal") > 0)
    return api.full_outer_join(api.select(_orders(spark, sf_dir), "custkey", "orderkey"), rich)


@query("SELECT c_custkey AS custkey, c_nationkey AS nationkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def semi_join(spark, sf_dir):
    return api.semi_join(_customers(spark, sf_dir), _orders(spark, sf_dir))


@query("SELECT c_custkey AS custkey, c_nationkey AS nationkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def anti_join(spark, sf_dir):
    return api.anti_join(_customers(spark, sf_dir), _orders(spark, sf_dir))


@query("SELECT r_regionkey, r_name, n_nationkey, n_name, n_regionkey FROM region CROSS JOIN nation")
def cross_join(spark, sf_dir):
    return api.cross_join(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"))


@query("SELECT c_custkey AS custkey, c_nationkey AS nationkey, c_acctbal, n_name, n_regionkey AS regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def broadcast_join(spark, sf_dir):
    return api.inner_join(_customers(spark, sf_dir), api.broadcast(_nations(spark, sf_dir)))


@query("""SELECT n_name, r_name, ROUND(SUM(o_totalprice), 2) AS total, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 150000 GROUP BY 1, 2""")
def multi_join(spark, sf_dir):
    regions = api.rename(table(spark, sf_dir, "region"), {"r_regionkey": "regionkey"})
    rows = _orders(spark, sf_dir)
    for other in (_customers(spark, sf_dir), _nations(spark, sf_dir), regions):
        rows = api.inner_join(rows, other)
    out = api.aggregate(rows, ["n_name", "r_name"], total=f.sum("o_totalprice"), n=f.count("*"))
    return api.assign(out, total=function("round", col("total"), 2))


# Aggregation


@query("SELECT g AS l_returnflag, lo, hi, total, mean, n, n_all FROM (SELECT l_returnflag AS g, MIN(l_quantity) AS lo, MAX(l_extendedprice) AS hi, ROUND(SUM(l_quantity), 4) AS total, ROUND(AVG(l_discount), 6) AS mean, COUNT(l_tax) AS n, COUNT(*) AS n_all FROM lineitem GROUP BY 1)")
def aggregate_basic(spark, sf_dir):
    out = api.aggregate(table(spark, sf_dir, "lineitem"), "l_returnflag", lo=f.min("l_quantity"), hi=f.max("l_extendedprice"), total=f.sum("l_quantity"), mean=f.avg("l_discount"), n=f.count("l_tax"), n_all=f.count("*"))
    return api.assign(out, total=function("round", col("total"), 4), mean=function("round", col("mean"), 6))


@query("SELECT MIN(o_totalprice) AS lo, MAX(o_orderkey) AS hi, COUNT(*) AS n FROM orders")
def aggregate_global(spark, sf_dir):
    return api.aggregate(table(spark, sf_dir, "orders"), lo=f.min("o_totalprice"), hi=f.max("o_orderkey"), n=f.count("*"))


@query("SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def count_distinct(spark, sf_dir):
    return api.aggregate(table(spark, sf_dir, "events"), "event_type", users=f.count_distinct("user_id"))


@query("SELECT o_custkey, (MIN(o_orderkey) + MAX(o_orderkey)) / 2 AS middle, COUNT(*) * 2 AS twice FROM orders GROUP BY 1 HAVING COUNT(*) > 5")
def aggregate_expressions(spark, sf_dir):
    middle = ((f.min("o_orderkey") + f.max("o_orderkey")) / 2).alias("middle")
    return api.select(table(spark, sf_dir, "orders"), "o_custkey", middle, (f.count("*") * 2).alias("twice"), having=f.count("*") > 5)


@query("SELECT o_orderstatus, 7 AS seven, MAX(o_totalprice) AS o_totalprice FROM orders GROUP BY o_orderstatus")
def aggregate_literal(spark, sf_dir):
    return api.select(table(spark, sf_dir, "orders"), "o_orderstatus", lit(7, "seven"), f.max("o_totalprice"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(spark, sf_dir):
    return api.distinct(api.select_columns(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"]))


@query("""SELECT c_mktsegment, ROUND(STDDEV_SAMP(c_acctbal), 4) AS spread, ROUND(VAR_POP(c_acctbal), 2) AS var, ROUND(CORR(c_acctbal, c_nationkey), 6) AS r,
  MEDIAN(c_acctbal) AS mid, ARG_MAX(c_custkey, c_acctbal) AS richest FROM customer GROUP BY 1""")
def aggregate_statistics(spark, sf_dir):
    rows = api.aggregate(
        table(spark, sf_dir, "customer"), "c_mktsegment",
        spread=function("stddev_samp", col("c_acctbal")), var=function("var_pop", col("c_acctbal")),
        r=agg_function("corr", col("c_acctbal"), col("c_nationkey")), mid=agg_function("median", col("c_acctbal")),
        richest=agg_function("max_by", col("c_custkey"), col("c_acctbal")),
    )
    return api.assign(rows, spread=function("round", col("spread"), 4), var=function("round", col("var"), 2), r=function("round", col("r"), 6))


@query()
def aggregate_first_last(spark, sf_dir):
    return api.aggregate(table(spark, sf_dir, "orders"), "o_orderstatus", first=f.first("o_orderkey"), last=f.last("o_orderkey"))


# Order, top-k and sampling


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def take_global(spark, sf_dir):
    return api.take(table(spark, sf_dir, "orders"), 25, "o_totalprice desc, o_orderkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 2")
def take_per_key(spark, sf_dir):
    rows = api.select_columns(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey", "o_totalprice"])
    return api.take(rows, 2, "o_totalprice desc, o_orderkey", partition="o_custkey")


@query("SELECT doc_id, quality FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) ORDER BY quality DESC NULLS FIRST, doc_id LIMIT 40")
def take_nulls_first(spark, sf_dir):
    rows = api.left_outer_join(api.select_columns(table(spark, sf_dir, "documents"), ["doc_id"]), api.select_columns(table(spark, sf_dir, "labels"), ["doc_id", "quality"]))
    return api.take(rows, 40, "quality desc, doc_id", na_position="first")


@query("SELECT 300 AS n, 1 AS parts")
def sample_rows(spark, sf_dir):
    rows = api.sample(table(spark, sf_dir, "orders"), n=300, seed=5)
    return api.select(rows, f.count("*").alias("n"), lit(1, "parts"))


@query()
def sample_share(spark, sf_dir):
    return api.sample(table(spark, sf_dir, "orders"), frac=0.1, seed=3)


@query("SELECT 500 AS n")
def sample_replace(spark, sf_dir):
    return api.select(api.sample(table(spark, sf_dir, "nation"), n=500, replace=True, seed=1), f.count("*").alias("n"))


# Set operations


def _keys(spark, sf_dir):
    a = api.select(table(spark, sf_dir, "customer"), col("c_nationkey", "k"))
    return a, api.select(table(spark, sf_dir, "supplier"), col("s_nationkey", "k"), where=col("s_nationkey") > 5)


for _name, _sql, _how, _distinct in (
    ("union_distinct", "UNION", "union", True), ("union_all", "UNION ALL", "union", False),
    ("subtract_distinct", "EXCEPT", "subtract", True), ("subtract_all", "EXCEPT ALL", "subtract", False),
    ("intersect_distinct", "INTERSECT", "intersect", True), ("intersect_all", "INTERSECT ALL", "intersect", False),
):
    QUERIES[_name] = lambda spark, sf_dir, how=_how, distinct=_distinct: api.set_op(how, *_keys(spark, sf_dir), distinct=distinct)
    ORACLE_SQL[_name] = f"SELECT c_nationkey AS k FROM customer {_sql} SELECT s_nationkey FROM supplier WHERE s_nationkey > 5"


# Null handling; the labels cover some documents only

_LABELLED = "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _labelled(spark, sf_dir):
    return api.left_outer_join(api.select_columns(table(spark, sf_dir, "documents"), ["doc_id"]), table(spark, sf_dir, "labels"))


@query(f"SELECT * FROM ({_LABELLED}) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def dropna_any(spark, sf_dir):
    return api.dropna(_labelled(spark, sf_dir))


@query(f"SELECT * FROM ({_LABELLED}) WHERE quality IS NOT NULL OR toxic IS NOT NULL")
def dropna_all(spark, sf_dir):
    return api.dropna(_labelled(spark, sf_dir), how="all", subset=["quality", "toxic"])


@query(f"SELECT * FROM ({_LABELLED}) WHERE 1 + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT >= 2")
def dropna_thresh(spark, sf_dir):
    return api.dropna(_labelled(spark, sf_dir), thresh=2)


@query(f"SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM ({_LABELLED})")
def fillna_dict(spark, sf_dir):
    return api.fillna(_labelled(spark, sf_dir), {"quality": -1, "toxic": 0})


@query(f"SELECT doc_id, coalesce(quality, 5) AS quality, toxic FROM ({_LABELLED})")
def fillna_subset(spark, sf_dir):
    return api.fillna(_labelled(spark, sf_dir), 5, subset=["quality"])


@query(f"SELECT doc_id, coalesce(quality, toxic, 9) AS c, quality IS NULL AS missing, toxic IS NOT NULL AS there FROM ({_LABELLED})")
def coalesce_nulls(spark, sf_dir):
    return api.select(_labelled(spark, sf_dir), "doc_id", f.coalesce(col("quality"), col("toxic"), 9).alias("c"), col("quality").is_null().alias("missing"), col("toxic").not_null().alias("there"))


# Expressions


@query("SELECT l_orderkey, l_linenumber, -l_quantity AS neg, (l_quantity + 2) * 3 - 1 AS mix, 10 / l_quantity AS part, CAST(l_quantity AS BIGINT) AS whole FROM lineitem")
def expression_arithmetic(spark, sf_dir):
    q = col("l_quantity")
    return api.select(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", (-q).alias("neg"), ((q + 2) * 3 - 1).alias("mix"), (10 / q).alias("part"), q.cast("long").alias("whole"))


@query(f"SELECT doc_id, quality = 1 AND toxic = 0 AS both, quality = 1 OR toxic = 1 AS either, NOT (quality = 1) AS no FROM ({_LABELLED})")
def expression_logic(spark, sf_dir):
    q, t = col("quality") == 1, col("toxic") == 1
    return api.select(_labelled(spark, sf_dir), "doc_id", (q & (col("toxic") == 0)).alias("both"), (q | t).alias("either"), (~q).alias("no"))


@query("SELECT o_orderkey, o_totalprice < 1000 AS lt, o_totalprice <= 1000 AS le, o_totalprice > 1000 AS gt, o_totalprice >= 1000 AS ge, o_orderstatus = 'F' AS eq, o_orderstatus <> 'F' AS ne FROM orders")
def expression_comparison(spark, sf_dir):
    p, s = col("o_totalprice"), col("o_orderstatus")
    return api.select(table(spark, sf_dir, "orders"), "o_orderkey", (p < 1000).alias("lt"), (p <= 1000).alias("le"), (p > 1000).alias("gt"), (p >= 1000).alias("ge"), (s == "F").alias("eq"), (s != "F").alias("ne"))


@query("SELECT upper(p_name) AS up, length(p_name) AS n, substr(p_brand, 1, 5) AS head, concat(p_brand, '-', p_type) AS both, replace(p_type, ' ', '_') AS glued, trim('  ' || p_brand || ' ') AS bare FROM part")
def functions_string(spark, sf_dir):
    return api.select(
        table(spark, sf_dir, "part"), function("upper", col("p_name")).alias("up"), function("length", col("p_name")).alias("n"),
        function("substr", col("p_brand"), 1, 5).alias("head"), function("concat", col("p_brand"), "-", col("p_type")).alias("both"),
        function("replace", col("p_type"), " ", "_").alias("glued"), function("trim", function("concat", "  ", col("p_brand"), " ")).alias("bare"),
    )


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, strftime(o_orderdate, '%Y-%m') AS start, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate)::INT AS days FROM orders")
def functions_date(spark, sf_dir):
    return api.raw_sql("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_format(o_orderdate, 'yyyy-MM') AS start, datediff(o_orderdate, DATE '1992-01-01') AS days FROM", table(spark, sf_dir, "orders"))


@query("SELECT c_custkey, abs(c_acctbal) AS a, CAST(floor(c_acctbal) AS BIGINT) AS lo, CAST(ceil(c_acctbal) AS BIGINT) AS hi, round(sqrt(abs(c_acctbal)), 6) AS root, round(ln(abs(c_acctbal) + 1), 6) AS log, c_custkey % 7 AS rest FROM customer")
def functions_math(spark, sf_dir):
    return api.raw_sql("SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal) AS lo, ceil(c_acctbal) AS hi, round(sqrt(abs(c_acctbal)), 6) AS root, round(ln(abs(c_acctbal) + 1), 6) AS log, c_custkey % 7 AS rest FROM", table(spark, sf_dir, "customer"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band, nullif(c_nationkey, 3) AS n, greatest(c_nationkey, 10) AS g FROM customer")
def functions_conditional(spark, sf_dir):
    return api.raw_sql("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band, nullif(c_nationkey, 3) AS n, greatest(c_nationkey, 10) AS g FROM", table(spark, sf_dir, "customer"))


@query("SELECT vec_id, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS head, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings")
def functions_array(spark, sf_dir):
    return api.raw_sql("SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, CAST(element_at(embedding, 1) AS DOUBLE) AS head, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS positive FROM", table(spark, sf_dir, "embeddings"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def functions_json(spark, sf_dir):
    return api.raw_sql("SELECT event_id, get_json_object(props, '$.k') AS k FROM", table(spark, sf_dir, "events"))


@query("SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
def functions_hash(spark, sf_dir):
    return api.raw_sql("SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s FROM", table(spark, sf_dir, "customer"))


@query("SELECT n_nationkey, n_name FROM nation")
def functions_struct_map(spark, sf_dir):
    return api.raw_sql("SELECT s.a AS n_nationkey, m['name'] AS n_name FROM (SELECT named_struct('a', n_nationkey) AS s, map('name', n_name) AS m FROM", table(spark, sf_dir, "nation"), ")")


# SELECT text


_WINDOWS = """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr,
 round(percent_rank() OVER w, 6) AS pr, ntile(3) OVER w AS tile, round(cume_dist() OVER w, 6) AS cd FROM {orders} AS orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""


@query(_WINDOWS.replace("{orders} AS orders", "orders"))
def window_ranking(spark, sf_dir):
    return spark.sql(_WINDOWS, orders=table(spark, sf_dir, "orders"))


_ANALYTIC = """SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS ahead, first_value(o_orderkey) OVER w AS f,
 last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER w AS second
 FROM {orders} AS orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""


@query(_ANALYTIC.replace("{orders} AS orders", "orders"))
def window_analytic(spark, sf_dir):
    return spark.sql(_ANALYTIC, orders=table(spark, sf_dir, "orders"))


_FRAMES = """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
 count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS ranged FROM {orders} AS orders"""


@query(_FRAMES.replace("{orders} AS orders", "orders"))
def window_frames(spark, sf_dir):
    return spark.sql(_FRAMES, orders=table(spark, sf_dir, "orders"))


for _name, _tail in (("sql_rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("sql_cube", "CUBE (l_returnflag, l_linestatus)"), ("sql_grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())")):
    _text = f"SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS q FROM {{lineitem}} AS lineitem GROUP BY {_tail}"
    QUERIES[_name] = lambda spark, sf_dir, text=_text: spark.sql(text, lineitem=table(spark, sf_dir, "lineitem"))
    ORACLE_SQL[_name] = _text.replace("{lineitem} AS lineitem", "lineitem")


@query("SELECT event_type, approx_count_distinct(user_id) > 0 AS some FROM events GROUP BY 1")
def aggregate_approximate(spark, sf_dir):
    return api.select(table(spark, sf_dir, "events"), "event_type", (agg_function("approx_count_distinct", col("user_id")) > 0).alias("some"))


_CTE = "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 8) SELECT c_custkey, n FROM customer JOIN big ON c_custkey = o_custkey"


@query(_CTE)
def sql_cte(spark, sf_dir):
    return api.xsql(_CTE, {"orders": table(spark, sf_dir, "orders"), "customer": table(spark, sf_dir, "customer")}, spark=spark, scope={})


_SUBQUERIES = """SELECT c_custkey, c_acctbal FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)"""


@query(_SUBQUERIES)
def sql_subqueries(spark, sf_dir):
    names = ("customer", "orders", "nation")
    return api.xsql(_SUBQUERIES, {n: table(spark, sf_dir, n) for n in names}, spark=spark, scope={})


_SETS = "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1"


@query(_SETS)
def sql_set_operations(spark, sf_dir):
    names = ("customer", "supplier", "nation")
    return api.xsql(_SETS, {n: table(spark, sf_dir, n) for n in names}, spark=spark, scope={})


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def sql_order_limit_offset(spark, sf_dir):
    return api.raw_sql("SELECT o_orderkey, o_totalprice FROM", table(spark, sf_dir, "orders"), "ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")


@query("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def sql_theta_join(spark, sf_dir):
    return api.xsql("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", {"nation": table(spark, sf_dir, "nation")}, spark=spark, scope={})


@query("SELECT vec_id, i AS place, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)")
def sql_lateral(spark, sf_dir):
    return api.raw_sql("SELECT vec_id, CAST(i AS BIGINT) AS place, CAST(x AS DOUBLE) AS x FROM", table(spark, sf_dir, "embeddings"), "LATERAL VIEW posexplode(embedding) t AS i, x")


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS o, count(*) FILTER (WHERE l_linestatus = 'F') AS f FROM lineitem GROUP BY 1")
def sql_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")
    return api.raw_sql("SELECT l_returnflag, coalesce(o, 0) AS o, coalesce(f, 0) AS f FROM", rows, "PIVOT (count(1) FOR l_linestatus IN ('O' AS o, 'F' AS f))")


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(x, y)")
def sql_values(spark, sf_dir):
    return spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(x, y)")


# User functions


def _shares(df: pd.DataFrame) -> pd.DataFrame:
    """Each row's share of its group, and its place in the group's order."""
    return df.assign(share=(df["o_totalprice"] / df["o_totalprice"].sum()).round(6), place=range(len(df)))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders""")
def transform_keyed(spark, sf_dir):
    rows = api.select_columns(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey", "o_totalprice"])
    return api.transform(rows, _shares, "*,share:double,place:long", partition={"by": "o_custkey", "presort": "o_totalprice desc, o_orderkey"})


def _doubled(tables: Iterable[pa.Table]) -> Iterable[pa.Table]:
    for t in tables:
        yield t.append_column("twice", pc.multiply(t.column("p_size").cast(pa.int64()), 2))


@query("SELECT p_partkey, p_size, p_size * 2 AS twice FROM part")
def transform_arrow(spark, sf_dir):
    return api.transform(api.select_columns(table(spark, sf_dir, "part"), ["p_partkey", "p_size"]), _doubled, "*,twice:long")


def _words(rows: Iterable[dict[str, Any]]) -> Iterable[dict[str, Any]]:
    for r in rows:
        yield {"p_partkey": r["p_partkey"], "n_words": len(r["p_name"].split(" "))}


@query("SELECT p_partkey, len(string_split(p_name, ' ')) AS n_words FROM part")
def transform_rows(spark, sf_dir):
    return api.transform(api.select_columns(table(spark, sf_dir, "part"), ["p_partkey", "p_name"]), _words, "p_partkey:long,n_words:long")


def _sizes(customers: pd.DataFrame, suppliers: pa.Table) -> list[list[Any]]:
    key = customers["nationkey"].iloc[0] if len(customers) else suppliers.column("nationkey")[0].as_py()
    return [[int(key), len(customers), suppliers.num_rows]]


@query("""SELECT coalesce(a.k, b.k) AS nationkey, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey > 3 GROUP BY 1) a
  FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def cotransform_sizes(spark, sf_dir):
    a = api.filter(_customers(spark, sf_dir), col("nationkey") > 3)
    b = api.select(table(spark, sf_dir, "supplier"), col("s_nationkey", "nationkey"), "s_suppkey")
    return api.cotransform(api.zip_frames([a, b], "full_outer"), _sizes, "nationkey:int,customers:long,suppliers:long")


# Statements of the extended SQL


def _script(text: str, *names: str):
    def run(spark, sf_dir):
        return api.xsql(text, {n: table(spark, sf_dir, n) for n in names}, spark=spark, scope={"_shares": _shares})

    return run


for _name, _text, _sql, *_tables in (
    ("xsql_rename", "RENAME COLUMNS n_name:name FROM nation", "SELECT n_nationkey, n_name AS name, n_regionkey FROM nation", "nation"),
    ("xsql_alter", "ALTER COLUMNS n_nationkey:str FROM nation", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, n_regionkey FROM nation", "nation"),
    ("xsql_drop", "DROP COLUMNS n_name, absent IF EXISTS FROM nation", "SELECT n_nationkey, n_regionkey FROM nation", "nation"),
    ("xsql_drop_rows", "x = SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id DROP ROWS IF ANY NULLS ON quality FROM x", f"SELECT doc_id, quality FROM ({_LABELLED}) WHERE quality IS NOT NULL", "documents", "labels"),
    ("xsql_fill", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id FILL NULLS (quality=-1)", f"SELECT doc_id, coalesce(quality, -1) AS quality FROM ({_LABELLED})", "documents", "labels"),
    ("xsql_take", "TAKE 1 ROW FROM orders PREPARTITION BY o_custkey PRESORT o_totalprice DESC, o_orderkey", "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1", "orders"),
    ("xsql_sample", "x = SAMPLE 7 ROWS SEED 1 FROM orders SELECT count(*) AS n FROM x", "SELECT 7 AS n", "orders"),
    ("xsql_select", "x = SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey SELECT count(*) AS n, round(max(total), 2) AS most WHERE total > 1000", "SELECT count(*) AS n, round(max(total), 2) AS most FROM (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) WHERE total > 1000", "orders"),
    ("xsql_create", "CREATE [[1, 'a'], [2, NULL]] SCHEMA k:int,v:str", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) t(k, v)"),
    ("xsql_transform", "x = SELECT o_custkey, o_orderkey, o_totalprice FROM orders TRANSFORM x PREPARTITION BY o_custkey PRESORT o_totalprice DESC, o_orderkey USING _shares SCHEMA *,share:double,place:long SELECT o_orderkey, place WHERE place < 2", "SELECT o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders) WHERE place < 2", "orders"),
    ("xsql_set_operations", "SELECT c_nationkey AS k FROM customer UNION TAKE 3 ROWS FROM (SELECT n_nationkey AS k FROM nation) PRESORT k", "SELECT c_nationkey AS k FROM customer UNION SELECT * FROM (SELECT n_nationkey FROM nation ORDER BY 1 LIMIT 3)", "customer", "nation"),
):
    QUERIES[_name] = _script(_text, *_tables)
    ORACLE_SQL[_name] = _sql


# Files, tables, placement and pipelines; copies go to the shared folder


def _scratch(spark, name: str) -> str:
    """A new path where all executors can write: below spark.checkpoint.dir, or a local folder where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lamina-")
    return f"{base.rstrip('/')}/lamina/{uuid.uuid4().hex}/{name}"


_SUPPLIERS = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


@query(_SUPPLIERS)
def io_csv(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    path = _scratch(spark, "s.csv")
    api.save(rows, path, header=True)
    return api.load(spark, path, header=True, columns="s_suppkey:long,s_name:str,s_nationkey:int,s_acctbal:double")


@query(_SUPPLIERS)
def io_json(spark, sf_dir):
    path = _scratch(spark, "s.json")
    api.save(table(spark, sf_dir, "supplier"), path)
    return api.load(spark, path, columns="s_suppkey:long,s_name:str,s_nationkey:int,s_acctbal:double")


@query(_SUPPLIERS)
def io_single_file(spark, sf_dir):
    return api.save_and_use(table(spark, sf_dir, "supplier"), _scratch(spark, "s.parquet"), force_single=True)


@query(_SUPPLIERS + " WHERE s_nationkey = 3")
def io_partitioned(spark, sf_dir):
    path = _scratch(spark, "s")
    api.save(table(spark, sf_dir, "supplier"), path, "parquet", partition={"by": ["s_nationkey"], "num": 4})
    return api.filter(api.load(spark, path, "parquet", columns="s_suppkey:long,s_name:str,s_nationkey:int,s_acctbal:double"), col("s_nationkey") == 3)


@query("SELECT count(*) AS n FROM nation")
def io_table(spark, sf_dir):
    name = f"lamina_{uuid.uuid4().hex}"
    api.save_table(table(spark, sf_dir, "nation"), name)
    return api.select(api.load_table(spark, name), f.count("*").alias("n"))


@query("SELECT 7 AS parts, count(*) AS n FROM orders")
def repartition_even(spark, sf_dir):
    rows = api.repartition(api.select_columns(table(spark, sf_dir, "orders"), ["o_orderkey"]), {"num": 7, "algo": "even"})
    sizes = rows.groupBy(F.spark_partition_id().alias("p")).count()
    return sizes.agg(F.count("*").alias("parts"), F.sum("count").alias("n"))


@query("SELECT count(DISTINCT o_orderpriority) AS parts, count(DISTINCT o_orderpriority) AS keys FROM orders")
def repartition_by_key(spark, sf_dir):
    rows = api.repartition(api.select_columns(table(spark, sf_dir, "orders"), ["o_orderpriority"]), {"by": ["o_orderpriority"], "algo": "even"})
    placed = rows.withColumn("p", F.spark_partition_id())
    return placed.agg(F.count_distinct("p").alias("parts"), F.count_distinct("p", "o_orderpriority").alias("keys"))


@query("SELECT o_custkey, sum(o_totalprice) > 500000 AS big FROM orders GROUP BY 1")
def flow_pipeline(spark, sf_dir):
    flow = api.Flow(checkpoint_path=_scratch(spark, "flow"), auto_persist=False)
    orders = flow.load(f"{sf_dir}/orders.parquet", columns=["o_custkey", "o_totalprice"]).deterministic_checkpoint()
    totals = orders.partition_by("o_custkey").aggregate(total=f.sum("o_totalprice"))
    totals.assign(big=col("total") > 500000)[["o_custkey", "big"]].yield_dataframe_as("out")
    return flow.run(spark)["out"]


@query("SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1")
def transform_callback(spark, sf_dir):
    """Workers call the driver once a key; a repeated task would repeat its call, so the last word of a key counts."""
    told: dict[int, int] = {}
    api.out_transform(api.select(table(spark, sf_dir, "supplier"), col("s_nationkey", "k")), _tell, partition="k", callback=told.__setitem__)
    return frame(spark, sorted(map(list, told.items())), "k:int,n:long")


def _tell(rows: list[list[Any]], say: Callable) -> None:
    say(rows[0][0], len(rows))


from . import queries_flow  # noqa: E402, F401  registers the queries of user functions, scripts and pipelines
