"""Files and catalog tables."""

from __future__ import annotations

import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import SchemaError
from ..operators.partition import PartitionSpec, current_parallelism, partition_spec, repartition
from ..operators.relational import enforce, ref, select_columns
from ..schema import parse_schema

_SUFFIXES = {".csv": "csv", ".csv.gz": "csv", ".parquet": "parquet", ".json": "json", ".json.gz": "json"}
MODES = ("overwrite", "append", "error")


def file_format(paths: str | list[str], hint: str | None = None) -> str:
    """Of a hint, or of the suffix that all paths share. Other formats need the hint."""
    if hint:
        return hint.lower()
    found = set()
    for p in [paths] if isinstance(paths, str) else paths:
        name = p.rstrip("/").rpartition("/")[2].lower()
        m = re.search(r"(\.[a-z]+(?:\.gz)?)$", name)
        found.add(_SUFFIXES.get(m[1] if m else ""))
    if len(found) != 1 or None in found:
        raise NotImplementedError(f"no single known format in {paths}")
    return found.pop()


def _pick(df: DataFrame, columns: Any) -> DataFrame:
    """A list of names projects, a schema projects and casts."""
    if not columns:
        return df
    if isinstance(columns, (list, tuple)) and all(isinstance(c, str) and ":" not in c for c in columns):
        return select_columns(df, list(columns))
    return enforce(df, columns)


def _load_csv(spark: SparkSession, paths: list[str], columns: Any, header: Any = False, infer_schema: Any = False, **options: Any) -> DataFrame:
    truth = {"true": True, "false": False, "": False}
    header = truth.get(str(header).lower(), header) if header is not None else False
    infer = str(infer_schema).lower() == "true"
    if not isinstance(header, bool):
        raise NotImplementedError(f"header {header!r}")
    names = isinstance(columns, (list, tuple)) and all(isinstance(c, str) and ":" not in c for c in columns)
    if columns and not names and infer:
        raise ValueError("a schema leaves nothing to infer")
    if not header and not columns:
        raise ValueError("without a header, columns are needed")
    reader = spark.read.options(**{"header": header, "inferSchema": infer, **options})
    if header:
        return _pick(reader.csv(paths), columns)
    if names:
        df = reader.csv(paths)
        if len(df.columns) != len(columns):
            raise SchemaError(f"{len(df.columns)} columns, not {len(columns)}")
        return df.toDF(*columns)
    want = parse_schema(columns)
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in want.fields])
    return enforce(reader.schema(texts).csv(paths), want)


def load(spark: SparkSession, path: str | list[str], format_hint: str | None = None, columns: Any = None, **options: Any) -> DataFrame:
    """Reads files, folders or globs. Texts in columns project, a schema projects and casts.

    CSV columns are texts unless a schema or infer_schema says more; JSON is a record a line.
    """
    paths = [path] if isinstance(path, str) else list(path)
    kind = file_format(paths, format_hint)
    if kind == "csv":
        return _load_csv(spark, paths, columns, **options)
    return _pick(spark.read.format(kind).options(**options).load(paths), columns)


def save(df: DataFrame, path: str, format_hint: str | None = None, mode: str = "overwrite", partition: Any = None, force_single: bool = False, **options: Any) -> None:
    """Writes a folder, with one subfolder a key value for partition keys; force_single writes one file instead."""
    if mode not in MODES:
        raise NotImplementedError(f"mode {mode!r}")
    kind, spec = file_format(path, format_hint), partition_spec(partition)
    if kind == "csv":
        options = {"header": str(options.pop("header", False)).lower(), **options}
    if force_single:
        _save_single(df, path, kind, mode, options)
        return
    n = spec.partitions(df.count, current_parallelism(df.sparkSession))
    if n and spec.by:
        df = df.repartition(n, *map(ref, spec.by))
    elif not spec.empty:
        df = repartition(df, PartitionSpec(spec.num, spec.algo, (), spec.presort))
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*spec.by) if spec.by else writer).save(path)


def _save_single(df: DataFrame, path: str, kind: str, mode: str, options: dict[str, Any]) -> None:
    """One task writes one file beside the target, which is then renamed: no row passes the driver."""
    if mode == "append":
        raise NotImplementedError("a single file cannot be appended to")
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target) and mode == "error":
        raise FileExistsError(path)
    part = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.coalesce(1).write.format(kind).options(**options).save(part)
    try:
        files = [s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(part)) if s.getPath().getName().startswith("part-")]
        fs.delete(target, True)
        fs.rename(files[0], target) if files else fs.create(target, True).close()
    finally:
        fs.delete(jvm.org.apache.hadoop.fs.Path(part), True)


def save_and_use(df: DataFrame, path: str, format_hint: str | None = None, mode: str = "overwrite", partition: Any = None, force_single: bool = False, **options: Any) -> DataFrame:
    """Saves, then reads what was saved: the lineage ends there."""
    kind, schema = file_format(path, format_hint), df.schema
    save(df, path, kind, mode, partition, force_single, **options)
    back = {"columns": schema} if kind == "csv" and str(options.get("header", False)).lower() != "true" else {}
    again = load(df.sparkSession, path, kind, **back, **options)
    return enforce(again, schema)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def load_table(spark: SparkSession, name: str, columns: Any = None) -> DataFrame:
    return _pick(spark.table(name), columns)


def save_table(df: DataFrame, name: str, mode: str = "overwrite", partition: Any = None, **options: Any) -> None:
    if mode not in MODES:
        raise NotImplementedError(f"mode {mode!r}")
    spec = partition_spec(partition)
    writer = df.write.mode(mode).options(**options)
    (writer.partitionBy(*spec.by) if spec.by else writer).saveAsTable(name)
