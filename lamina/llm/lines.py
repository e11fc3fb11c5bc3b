"""Line dedup over levelled sorted runs of line hashes.

The runs live in a shared folder: level 0 takes the sorted hash counts of each new batch; when a level holds as many
runs as the fan-out, they are merged into one run of the next level. A batch adds its own hashes, then its lines are
anti-joined with the hashes that enough documents hold. Hashes have 128 bits, so a chance clash of two lines is beyond
any corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Sink, bounded, remove, rows, scratch, stored

#: Stripped from both ends of a line for its key: the bytes 0x20 and 0x09 to 0x0D.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
HASHES = ["h1", "h2"]
LINES = pa.schema([("rk", pa.binary()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("first", pa.bool_()), ("long_enough", pa.bool_())])


class LineRuns:
    """Sorted runs of (h1, h2, n documents) in levels. One writer at a time.

    All runs are bucketed by hash alike, and sorted in each bucket, so a new batch meets each former run in a merge join
    that moves nothing of the run; only compaction shuffles runs, those of a full level, once. Manifests are numbered,
    and a new one appears by renaming, so a failed job leaves the former state; a batch whose name a manifest holds is
    not added again. Readers sum the runs.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path or scratch(spark, "line-runs"), fanout
        self.buckets = self.state().get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _manifests(self) -> list[int]:
        fs, at = self._fs(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))

    def state(self) -> dict:
        """levels, batches and buckets of the latest manifest."""
        numbers = self._manifests()
        if not numbers:
            return {"levels": [], "batches": []}
        fs, at = self._fs(f"{self.path}/manifest-{numbers[-1]}.json")
        stream = fs.open(at)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def levels(self) -> list[list[str]]:
        return self.state()["levels"]

    def _put(self, levels: list[list[str]], batches: list[str]) -> None:
        numbers = self._manifests()
        fs, at = self._fs(f"{self.path}/manifest-{(numbers or [0])[-1] + 1}.json")
        _, made = self._fs(f"{self.path}/new-manifest-{uuid.uuid4().hex}")
        stream = fs.create(made, False)
        stream.write(bytearray(json.dumps({"levels": levels, "batches": batches, "buckets": self.buckets}).encode()))
        stream.close()
        if not fs.rename(made, at):
            raise OSError(f"{at} was written by another writer")
        for n in numbers[:-1]:  # the former one stays for readers that have just found it
            remove(self.spark, f"{self.path}/manifest-{n}.json")

    def _table(self, name: str) -> DataFrame:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(f"`{name}`")

    def _merged(self, names: list[str]) -> DataFrame:
        whole = self.spark.read.schema("h1 long, h2 long, n long").parquet(*[f"{self.path}/{n}" for n in names])
        return whole.groupBy(*HASHES).agg(F.sum("n").alias("n"))

    def _write(self, counts: DataFrame, level: int) -> str:
        name = f"lamina_lines_{level}_{uuid.uuid4().hex}"
        counts.select("h1", "h2", "n").write.format("parquet").bucketBy(self.buckets, *HASHES).sortBy(*HASHES).option("path", f"{self.path}/{name}").saveAsTable(f"`{name}`")
        return name

    def _delete(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        remove(self.spark, f"{self.path}/{name}")

    def add(self, counts: DataFrame, batch: str | None = None, least: int = 1) -> DataFrame:
        """Adds one batch's distinct hashes with their document counts as a run, then compacts full levels.

        Gives those hashes of the batch that at least so many documents of all batches hold, with their number. batch
        names it: a repeated job with the same name adds nothing.
        """
        state = self.state()
        levels, batches = state["levels"] or [[]], state["batches"]
        again, name = batch is not None and batch in batches, self._write(counts, 0)
        own = self._table(name)
        met = own.withColumn("n", F.lit(0).cast("long")) if again else own
        for run in [n for level in levels for n in level]:
            met = met.hint("merge").join(self._table(run).withColumnRenamed("n", "more"), HASHES, "left").select(*HASHES, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        found = stored(met.where(F.col("n") >= least), "common-lines")
        if again:
            self._delete(name)
            return found
        if batch is not None:
            batches.append(batch)
        levels[0].append(name)
        self._put(levels, batches)
        at = 0
        while len(levels[at]) >= self.fanout:
            old = levels[at]
            if at + 1 == len(levels):
                levels.append([])
            levels[at + 1].append(self._write(self._merged(old), at + 1))
            levels[at] = []
            self._put(levels, batches)
            for name in old:
                self._delete(name)
            at += 1
        return found

    def counts(self) -> DataFrame:
        """Each hash once, with the documents of all batches that hold it."""
        names = [n for level in self.levels() for n in level]
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        return self._table(names[0]) if len(names) == 1 else self._merged(names)

    def remove(self) -> None:
        for name in [n for level in self.levels() for n in level]:
            self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        remove(self.spark, self.path)


def line_hashes(keyed: DataFrame, min_chars: int = 1) -> DataFrame:
    """(rk, text) to one row per line: its place, the hash of its key, and whether its text held that key before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, digest = Sink(LINES, 65536), xxhash.xxh3_128_digest
        for rk, text in rows(batches):
            seen: set[bytes] = set()
            for n, line in enumerate((text or "").encode().lower().split(b"\n")):  # bytes.lower() changes A-Z alone
                key = line.strip(BLANKS)
                h = digest(key)
                long_enough = len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)
                if sink.add(rk, n, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), h not in seen, long_enough):
                    yield sink.batch()
                seen.add(h)
        if sink.n:
            yield sink.batch()

    return bounded(keyed).mapInArrow(run, "rk binary, line int, h1 long, h2 long, first boolean, long_enough boolean")


def _rebuild(joined: DataFrame, text_col: str, kept_col: str, stats: tuple[str, str]) -> DataFrame:
    """Joins the kept lines of each text again; all other columns pass through."""
    names = [c for c in joined.columns if c != kept_col]
    kinds = ", ".join(f"`{c.replace('`', '``')}` {joined.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts, totals, dropped = [], [], []
                for text, kept in zip(b.column(text_col).to_pylist(), b.column(kept_col).to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    texts.append("\n".join([lines[n] for n in sorted(kept or ())]))
                    totals.append(len(lines))
                    dropped.append(len(lines) - len(kept or ()))
                columns = [pa.array(texts, pa.string()) if c == text_col else b.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, *stats])

    return bounded(joined).mapInArrow(run, f"{kinds}, `{stats[0]}` long, `{stats[1]}` long")


def drop_common_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, runs: LineRuns | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs with the lines gone whose key at least min_docs documents of this and all former batches of runs hold.

    batch names this batch, so that a repeated job counts it once. Adds the columns n_lines (before) and n_dropped; docs' own columns of these names are replaced. The texts are
    shuffled once, to meet their lists of kept lines; hot lines are counted on the map side and split in the anti-join.

    Defined cases: a null or empty text is one empty line and becomes an empty text; a key shorter than min_chars code
    points is never dropped; a row is a document, so repeated rows count each; a null id is a value like any other;
    a text all of whose lines go becomes empty; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop(n_lines, n_dropped)
    rk, kept_col = (next(n for i in range(len(docs.columns) + 1) if (n := f"{stem}{i or ''}") not in docs.columns) for stem in ("__rk", "__kept"))
    name = F.concat_ws("\0", F.coalesce(docs[id_col].cast("string"), F.lit("\1")), F.coalesce(docs[text_col], F.lit("")))
    keyed = docs.withColumn(rk, F.unhex(F.md5(name)))
    lines = stored(line_hashes(keyed.select(F.col(rk).alias("rk"), F.col(text_col).alias("text")), min_chars), "lines")
    own, runs = runs is None, runs or LineRuns(spark)
    counts = lines.where("first AND long_enough").groupBy(*HASHES).agg(F.count("*").alias("n"))
    common = runs.add(counts, batch, min_docs).select(*HASHES, F.lit(True).alias("long_enough"))
    if own:
        runs.remove()
    kept = lines.hint("merge").join(common, [*HASHES, "long_enough"], "left_anti")
    places = kept.groupBy(F.col("rk").alias(rk)).agg(F.collect_set("line").alias(kept_col))
    return _rebuild(keyed.hint("merge").join(places, rk, "left").drop(rk), text_col, kept_col, (n_lines, n_dropped))


def brute_force(texts: dict[int, str | None], min_docs: int) -> dict[int, tuple[int, int, str]]:
    """The same decisions in plain Python, for tests: id to (n_lines, n_dropped, SHA-256 of what stays)."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(BLANKS.decode()).translate(lower)
    held: dict[str, int] = {}
    for t in texts.values():
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            held[k] = held.get(k, 0) + 1
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if held.get(key(x), 0) < min_docs]
        out[i] = len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()
    return out
