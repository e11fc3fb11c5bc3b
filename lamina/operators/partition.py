"""Partition specs and physical placement."""

from __future__ import annotations

import ast
import json
import operator
import re
import tempfile
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .relational import need, ordering, parse_presort, ref

ALGORITHMS = ("default", "hash", "rand", "even", "coarse")
_WORDS = {"ROWCOUNT", "CONCURRENCY"}
_SIGNS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod}
_CALLS = {"min": min, "max": max, "int": int, "round": round, "abs": abs}


def _tree(text: str) -> ast.expr:
    """The arithmetic of a partition number, checked."""
    try:
        tree = ast.parse(text.strip() or "0", mode="eval").body
    except SyntaxError as e:
        raise SyntaxError(f"{text!r} is no partition number") from e

    def check(x: ast.AST) -> None:
        if isinstance(x, ast.BinOp) and type(x.op) in _SIGNS:
            check(x.left)
            check(x.right)
        elif isinstance(x, ast.UnaryOp) and isinstance(x.op, (ast.USub, ast.UAdd)):
            check(x.operand)
        elif isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id in _CALLS and not x.keywords:
            for a in x.args:
                check(a)
        elif not (isinstance(x, ast.Constant) and isinstance(x.value, (int, float)) or isinstance(x, ast.Name) and x.id in _WORDS):
            raise SyntaxError(f"{text!r} is no partition number")

    check(tree)
    return tree


@dataclass(frozen=True)
class PartitionSpec:
    """How rows are dealt out: num partitions (arithmetic over ROWCOUNT and CONCURRENCY), an algorithm, keys, an order
    within each partition, and limits to a partition's rows or bytes for user functions."""

    num: str = "0"
    algo: str = "default"
    by: tuple[str, ...] = ()
    presort: dict[str, bool] = field(default_factory=dict)
    size_limit: int = 0
    row_limit: int = 0

    def __post_init__(self) -> None:
        if self.algo not in ALGORITHMS:
            raise SyntaxError(f"unknown algorithm {self.algo!r}")
        _tree(self.num)
        if len(set(self.by)) < len(self.by):
            raise SyntaxError(f"doubled keys in {self.by}")
        if set(self.by) & set(self.presort):
            raise SyntaxError("a key needs no place in the order")

    @property
    def empty(self) -> bool:
        return self == PartitionSpec()

    def partitions(self, rows: Any = lambda: 0, concurrency: int = 1) -> int:
        """The number, 0 if left open; rows() counts only if the number asks for it."""
        words = {"CONCURRENCY": lambda: concurrency, "ROWCOUNT": rows}

        def value(x: ast.AST) -> Any:
            if isinstance(x, ast.BinOp):
                return _SIGNS[type(x.op)](value(x.left), value(x.right))
            if isinstance(x, ast.UnaryOp):
                return -value(x.operand) if isinstance(x.op, ast.USub) else value(x.operand)
            if isinstance(x, ast.Call):
                return _CALLS[x.func.id](*map(value, x.args))
            return words[x.id]() if isinstance(x, ast.Name) else x.value

        return max(0, int(value(_tree(self.num))))


def partition_spec(*args: Any, **options: Any) -> PartitionSpec:
    """Of a number, keys, "per_row", a JSON text, a dict, a spec, or several of these; later ones win."""
    out: dict[str, Any] = {}
    for a in (*args, options):
        if a is None or isinstance(a, (dict, str)) and not a:
            continue
        if isinstance(a, PartitionSpec):
            a = {k: getattr(a, k) for k in PartitionSpec.__dataclass_fields__ if getattr(a, k) != PartitionSpec.__dataclass_fields__[k].default}
        elif isinstance(a, bool):
            raise TypeError(f"{a!r} is no partition spec")
        elif isinstance(a, int):
            a = {"num": a}
        elif isinstance(a, (list, tuple)):
            a = {"by": a}
        elif isinstance(a, str):
            a = {"num": "ROWCOUNT", "algo": "even"} if a.lower() == "per_row" else json.loads(a) if a.lstrip().startswith("{") else {"by": [a]}
        if not isinstance(a, dict):
            raise TypeError(f"{a!r} is no partition spec")
        for k, v in a.items():
            k = {"partition_by": "by", "num_partitions": "num"}.get(k.lower(), k.lower())
            if k not in PartitionSpec.__dataclass_fields__:
                raise SyntaxError(f"unknown part {k!r} of a partition spec")
            out[k] = v
    if "by" in out:
        out["by"] = (out["by"],) if isinstance(out["by"], str) else tuple(out["by"])
    if "num" in out:
        out["num"] = str(out["num"]).upper() if not isinstance(out["num"], str) else out["num"]
    if "algo" in out:
        out["algo"] = str(out["algo"]).lower()
    if "presort" in out:
        out["presort"] = parse_presort(out["presort"])
    return PartitionSpec(**out)


def with_keys(spec: PartitionSpec, by: tuple[str, ...]) -> PartitionSpec:
    return replace(spec, by=by)


def current_parallelism(spark: SparkSession) -> int:
    context = spark.sparkContext
    return max(1, context.defaultParallelism // int(context.getConf().get("spark.task.cpus", "1")))


def steady(df: DataFrame) -> DataFrame:
    """df with the same rows in the same partitions each time it is computed.

    A scan with filters and projections is so by itself; behind an exchange, a cache or a random value the frame is
    checkpointed in the shared folder.
    """
    execution = df._jdf.queryExecution()
    if execution.analyzed().deterministic() and not re.search(r"Exchange|InMemory|Sample|Limit|PythonUDF|InArrow|InPandas", execution.executedPlan().toString()):
        return df
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lamina-"))
    return df.checkpoint()


def numbered(df: DataFrame, name: str = "__at") -> DataFrame:
    """Rows of a steady frame with dense numbers from 0, without one global sort: sizes of the partitions, then places
    within them."""
    marked = df.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    sizes = marked.groupBy("__part").count().collect()  # one number for each partition
    starts, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["__part"]):
        starts[r["__part"]], total = total, total + r["count"]
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    start = F.element_at(F.create_map(*[F.lit(x) for p in starts.items() for x in p]), F.col("__part"))
    return marked.withColumn(name, (start + F.col("__place")).cast("long")).drop("__part", "__place")


def repartition(df: DataFrame, *spec: Any, sort: bool = True) -> DataFrame:
    """Deals rows out and orders each partition by keys and presort.

    default, hash and coarse go by the hash of the keys, or round robin without keys; rand at random; even gives equal
    sizes, or one key a partition with keys, by explicit partition numbers.
    """
    s = partition_spec(*spec)
    need(df, [*s.by, *s.presort])
    n = s.partitions(df.count, current_parallelism(df.sparkSession))
    keys = [ref(c) for c in s.by]
    if s.algo == "even" and s.by:
        groups = steady(df.select(*[k.alias(f"__{i}") for i, k in enumerate(keys)]).distinct())
        places = numbered(groups)
        count = n or max(1, groups.count())
        same = reduce(Column.__and__, [k.eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)])
        placed = df.join(places, same, "inner").select(*map(ref, df.columns), (F.col("__at") % count).cast("int").alias("__to"))
        out = placed.repartitionById(count, F.col("__to")).drop("__to")
    elif s.algo == "even" and n:
        out = numbered(steady(df)).withColumn("__to", (F.col("__at") % n).cast("int")).drop("__at").repartitionById(n, F.col("__to")).drop("__to")
    elif s.algo == "rand" and n and not s.by:
        out = df.repartition(n, F.rand())
    elif keys:
        out = df.repartition(n, *keys) if n else df.repartition(*keys)
    elif n == 1:
        out = df.coalesce(1)
    else:
        out = df.repartition(n) if n else df
    order = [*(k.asc_nulls_last() for k in keys), *ordering(s.presort, df=df)] if sort else []
    return out.sortWithinPartitions(*order) if order else out


def persist(df: DataFrame, lazy: bool = False, level: Any = None) -> DataFrame:
    """Caches at a storage level, by name or value; at once unless lazy."""
    if isinstance(level, str):
        level = getattr(StorageLevel, level.upper())
    if level is not None and not isinstance(level, StorageLevel):
        raise ValueError(f"{level!r} is no storage level")
    out = df.persist(level) if level is not None else df.persist()
    if not lazy:
        out.count()
    return out
