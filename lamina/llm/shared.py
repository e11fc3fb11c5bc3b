"""What the operators of this subpackage share: scratch space and Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step of a Python worker handles at once; longer texts are cut at white space.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch that goes to a Python worker (and a row more, be it longer).
BATCH_BYTES = "4m"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new local one where that is unset and Spark runs on
    this machine alone, as in tests."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lamina-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/lamina/{what}-{uuid.uuid4().hex}"


#: Rows for each task that writes a table whose number of rows is known to have a bound, and the fewest such tasks.
ROWS_PER_TASK, FEWEST_TASKS = 50_000, 6


def stored(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: the lineage ends there and a lost executor costs nothing.

    rows, a bound or good guess of the number of rows, keeps a small table from becoming hundreds of tiny files; large
    ones are written by as many tasks as they have partitions.
    """
    path = scratch(df.sparkSession, what)
    if rows is not None:
        tasks = max(FEWEST_TASKS, -(-rows // ROWS_PER_TASK))
        if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(tasks)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing which is still to run reads."""
    for t in tables:
        remove(t.sparkSession, t.scratch_path)


def bounded(df: DataFrame) -> DataFrame:
    """df, whose Arrow batches are kept to BATCH_BYTES in its session, unless that has set a size itself: long texts must
    not meet in one batch."""
    if df.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, which may be remote."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_slices(data: bytes, limit: int = SLICE_BYTES) -> Iterator[bytes]:
    """Cuts UTF-8 text at white space into slices of about limit bytes; a longer run without white space stays whole."""
    at = 0
    while len(data) - at > limit:
        m = _SPACE.search(data, at + limit)
        end = m.start() if m else len(data)
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def rows(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """The rows of Arrow batches, a few at a time as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield from zip(*(c.to_pylist() for c in b.slice(at, step).columns), strict=True)


class Sink:
    """Gathers output rows column by column and gives them out as batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 8192, most_bytes: int = 8 << 20):
        self.schema, self.most, self.most_bytes = schema, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.columns, self.n, self.size = [[] for _ in self.schema], 0, 0

    def add(self, *values, size: int = 0) -> bool:
        """True if a batch is due."""
        for column, v in zip(self.columns, values, strict=True):
            column.append(v)
        self.n += 1
        self.size += size
        return self.n >= self.most or self.size >= self.most_bytes

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.clear()
        return out
