"""User functions over partitions: transform, zip and cotransform.

Everything travels as Arrow. Spark shuffles and sorts by keys and presort; a worker then cuts large batches where the key
changes, so a small group costs no batch of its own and a streaming function never holds its group. Cotransforms run in
applyInArrow. Only small things (schemas, specs, the function) go into a closure.
"""

from __future__ import annotations

import inspect
import typing
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError, ValidationError
from ..schema import arrow_schema, transform_schema
from .callbacks import remote
from .extensions import CoTransformer, Transformer, check_input, check_partition, declared_schema, no_wildcard, resolve, rules_of
from .frames import Frames, Signature, give, ordered, take_back, to_pandas
from .joins import join_kind
from .partition import PartitionSpec, partition_spec, repartition, with_keys
from .relational import need, ordering, ref

NOTHING = "_0:int"


@dataclass
class PartitionCursor:
    """Where a user function stands: its physical partition, the number of the logical one in it, and the key's values."""

    key_names: tuple[str, ...]
    key_values: tuple
    partition_no: int

    @property
    def key_value_array(self) -> list:
        return list(self.key_values)

    @property
    def key_value_dict(self) -> dict[str, Any]:
        return dict(zip(self.key_names, self.key_values, strict=True))

    @property
    def physical_partition_no(self) -> int:
        context = TaskContext.get()
        return context.partitionId() if context else 0


class _Call:
    """A user function or class with its parameters, ready for a worker: frames in, tables out."""

    def __init__(self, using: Any, params: dict[str, Any], ignore: tuple, schema: T.StructType, spec: PartitionSpec, callback: Any, out: T.StructType):
        self.params, self.ignore, self.spec, self.callback, self.schema, self.out = params, ignore, spec, callback, schema, out
        self.is_class = isinstance(using, (Transformer, CoTransformer))
        self.using = using
        self.signature = None if self.is_class else Signature.read(using)
        self.count = 0
        self.given, self.want = arrow_schema(schema), arrow_schema(out)

    @property
    def kind(self) -> str:
        """The form of frame that it takes."""
        return self.using.input_format if self.is_class else self.signature.frames[0][1]

    def _arguments(self) -> dict[str, Any]:
        out = dict(self.params)
        if self.signature and self.signature.callback and (self.callback is not None or self.signature.callback_needed):
            out[self.signature.callback] = self.callback
        return out

    def prepare(self, key: tuple) -> None:
        if self.is_class:
            u = self.using
            u.params, u.partition, u.callback, u.output_schema = self.params, self.spec, self.callback, self.out
            u.cursor = PartitionCursor(self.spec.by, key, self.count)
            if self.count == 0:
                u.on_init(self.schema)
        self.count += 1

    def one(self, key: tuple, tables: Iterator[Any]) -> Iterator[pa.Table]:
        """Over one logical partition: tables, or frames that are in the form it takes."""
        try:
            self.prepare(key)
            held = next(tables) if self.kind == "pandas" and isinstance(tables, _Ready) else give(tables, self.kind, self.given)
            result = self.using.transform(held) if self.is_class else self.using(held, **self._arguments())
            found = take_back(result, None if self.is_class else self.signature.output, self.want)
            if self.ignore:
                found = iter(list(found))  # nothing of a partition that fails on its way
        except self.ignore:
            return
        yield from found

    def many(self, key: tuple, groups: list[pa.Table], names: list[str] | None) -> Iterator[pa.Table]:
        """Over the frames of one key."""
        try:
            self.prepare(key)
            if self.is_class:
                dfs = [give(iter([g]), self.using.input_format, g.schema) for g in groups]
                result = self.using.transform(dict(zip(names, dfs, strict=True)) if names else dfs)
            else:
                kinds = self.signature.frames
                if len(kinds) == 1 and kinds[0][1].startswith("frames"):
                    form = kinds[0][1].partition("_")[2] or "pandas"
                    dfs = [give(iter([g]), form, g.schema) for g in groups]
                    result = self.using(Frames(zip(names or [f"_{i}" for i in range(len(dfs))], dfs, strict=True)), **self._arguments())
                else:
                    at = {n: i for i, n in enumerate(names)} if names and {n for n, _ in kinds} == set(names) else {n: i for i, (n, _) in enumerate(kinds)}
                    result = self.using(**{n: give(iter([groups[at[n]]]), k, groups[at[n]].schema) for n, k in kinds}, **self._arguments())
            found = take_back(result, None if self.is_class else self.signature.output, self.want)
            if self.ignore:
                found = iter(list(found))
        except self.ignore:
            return
        yield from found


def _instance(using: Any) -> Any:
    return using() if isinstance(using, type) else using


def _without_nan(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """NaN and null are one group, shown as null, and so are both zeros."""
    floats = {f.name: f.dataType for f in df.schema.fields if f.name in keys and isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns({c: F.when(~F.isnan(ref(c)), ref(c) + F.lit(0.0).cast(kind)) for c, kind in floats.items()}) if floats else df


class _Ready(Iterator):
    """One frame that is already in the form its function takes."""

    def __init__(self, frame: Any):
        self.frame = frame

    def __next__(self) -> Any:
        return self.frame


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal."""
    before, after = column.slice(0, len(column) - 1), column.slice(1)
    try:
        differ = pc.fill_null(pc.not_equal(after, before), False).to_numpy(zero_copy_only=False)
    except pa.ArrowNotImplementedError:  # nested keys
        values = column.to_pylist()
        return np.array([x != y for x, y in zip(values[1:], values, strict=False)], bool)
    missing = column.is_null().to_numpy(zero_copy_only=False)
    return differ | (missing[1:] != missing[:-1])


class KeyRuns:
    """Cuts batches that are sorted by keys into one run for each key, which may go over several batches."""

    def __init__(self, batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], frames: bool):
        self.batches, self.keys, self.frames = batches, keys, frames
        self.pieces = self._cut()
        self.ahead = next(self.pieces, None)

    def _cut(self) -> Iterator[tuple[tuple, bool, Any]]:
        """(key, whether the run begins here, table or a pandas frame of a whole run) of each piece."""
        last: tuple | None = None
        for b in self.batches:
            if not b.num_rows:
                continue
            table, columns = pa.Table.from_batches([b]), [b.column(b.schema.get_field_index(k)) for k in self.keys]
            cut = np.zeros(b.num_rows - 1, bool)
            for c in columns:
                cut |= _changes(c)
            starts = [0, *(np.flatnonzero(cut) + 1).tolist(), b.num_rows]
            # A batch is converted once, unless nulls would give its groups another kind of column than their own.
            whole = to_pandas(table) if self.frames and len(starts) > 8 and not any(c.null_count for c in b.columns) else None
            keys = list(zip(*(c.take(pa.array(starts[:-1])).to_pylist() for c in columns), strict=True))
            for i, (lo, hi) in enumerate(zip(starts, starts[1:], strict=False)):
                fresh = i > 0 or last is None or keys[0] != last
                inside = whole is not None and 0 < i < len(starts) - 2
                yield keys[i], fresh, whole.iloc[lo:hi].reset_index(drop=True) if inside else table.slice(lo, hi - lo)
            last = keys[-1]

    def _rest(self) -> Iterator[pa.Table]:
        """What remains of the run that began, piece by piece."""
        while True:
            piece, self.ahead = self.ahead[2], next(self.pieces, None)
            yield piece
            if self.ahead is None or self.ahead[1]:
                return

    def __iter__(self) -> Iterator[tuple[tuple, Iterator[Any]]]:
        while self.ahead is not None:
            key, _, piece = self.ahead
            if not isinstance(piece, pa.Table):
                self.ahead = next(self.pieces, None)
                yield key, _Ready(piece)
                continue
            run = self._rest()
            yield key, run
            for _ in run:  # what the function left
                pass


def _gathered(tables: Iterator[pa.Table], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Small tables as batches of some size."""
    held, n = [], 0
    for t in tables:
        if t.num_rows:
            held.append(t)
            n += t.num_rows
        if n >= rows:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


def _sliced(tables: Iterator[pa.Table], spec: PartitionSpec) -> Iterator[list[pa.Table]]:
    """A partition's tables in parts within the spec's limits."""
    if not spec.row_limit and not spec.size_limit:
        yield list(tables)
        return
    for t in tables:
        step = spec.row_limit or t.num_rows
        if spec.size_limit and t.num_rows:
            step = max(1, min(step, int(spec.size_limit / max(1.0, t.nbytes / t.num_rows))))
        for at in range(0, t.num_rows, max(1, step)):
            yield [t.slice(at, step)]


def _lay_out(df: DataFrame, using: Any, schema: Any, params: dict[str, Any], spec: PartitionSpec) -> T.StructType:
    """Checks the rules and gives the output schema."""
    rules = rules_of(using)
    check_partition(rules, spec)
    check_input(rules, df.schema)
    need(df, [*spec.by, *spec.presort])
    if isinstance(using, Transformer):
        using.params, using.partition = params, spec
        schema = schema if schema is not None else using.get_output_schema(df.schema)
    else:
        s = Signature.read(using)
        s.check_params(params, using)
        if not s.frames:
            raise ValidationError(f"{getattr(using, '__name__', using)} takes no frame")
        schema = schema if schema is not None else declared_schema(using)
        if schema is None and s.output == "none":
            schema = NOTHING
    if schema is None:
        raise SchemaError(f"the output schema of {getattr(using, '__name__', using)} is not declared")
    return transform_schema(df.schema, schema, **(params if callable(schema) else {}))


def map_partitions(df: DataFrame, using: Any, schema: Any = None, params: dict[str, Any] | None = None, partition: Any = None, callback: Callable | None = None, ignore_errors: Any = None) -> DataFrame:
    """The lazy core of transform."""
    using, spec, params = _instance(resolve("transformer", using)), partition_spec(partition), params or {}
    out = _lay_out(df, using, schema, params, spec)
    call = _Call(using, params, tuple(ignore_errors or ()), df.schema, spec, remote(df.sparkSession, callback) if callback else None, out)
    want = arrow_schema(out)
    keyed = spec.by and spec.algo != "coarse"
    if not keyed:
        dealt = df if spec.empty else repartition(df, spec)

        def over_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = (pa.Table.from_batches([b]) for b in batches if b.num_rows)
            streams = call.signature is not None and "_" in call.signature.frames[0][1]
            first = next(tables, None)
            if first is None:
                return
            every = (t for part in ([first], tables) for t in part)
            parts = [every] if streams and not spec.row_limit and not spec.size_limit else map(iter, _sliced(every, spec))
            for part in parts:
                for t in call.one((), part):
                    yield from t.to_batches()

        return dealt.mapInArrow(over_partition, out)

    rows = _without_nan(df, spec.by)
    n = spec.partitions(df.count, 1) if spec.num != "0" else 0
    if n or spec.algo == "even":
        rows = repartition(rows, PartitionSpec(spec.num, spec.algo, spec.by), sort=False)
    else:  # a stated number: by bytes, few tasks would get the many calls of small groups
        rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *map(ref, spec.by))
    limited = bool(spec.row_limit or spec.size_limit)

    def over_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.Table]:
            for key, run in KeyRuns(batches, spec.by, call.kind == "pandas" and not limited):
                for part in map(iter, _sliced(iter([pa.concat_tables(run)]), spec)) if limited else [run]:
                    yield from call.one(key, part)

        yield from _gathered(found())

    order = [*(k.asc_nulls_last() for k in map(ref, spec.by)), *ordering(spec.presort, df=df)]
    return rows.sortWithinPartitions(*order).mapInArrow(over_runs, out)


def transform(df: DataFrame | str, using: Any, schema: Any = None, params: dict[str, Any] | None = None, partition: Any = None, callback: Callable | None = None, ignore_errors: Any = None, persist: bool = False, as_local: bool = False, save_path: str | None = None, checkpoint: bool = False, spark: Any = None) -> Any:
    """Runs a function over each logical partition of a frame or of a Parquet path.

    With keys a partition is a key, nulls included; without, it is a physical partition, whole or in chunks as the
    annotation asks. An exception of ignore_errors empties its partition. Empty partitions are not called.
    """
    df = _source(df, spark)
    out = map_partitions(df, using, schema, params, partition, callback, ignore_errors)
    if persist:
        out = out.persist()
    if checkpoint and not save_path:
        out = out.checkpoint()
    if save_path:
        from ..sources.io import save_and_use

        out = save_and_use(out, save_path)
    return out.toPandas() if as_local else out


def _source(df: DataFrame | str, spark: Any) -> DataFrame:
    if not isinstance(df, str):
        return df
    from pyspark.sql import SparkSession

    from ..sources.io import file_format, load

    if file_format(df) != "parquet":
        raise ValueError("only a Parquet path stands for a frame")
    return load(spark or SparkSession.active(), df)


def out_transform(df: DataFrame | str, using: Any, params: dict[str, Any] | None = None, partition: Any = None, callback: Callable | None = None, ignore_errors: Any = None, spark: Any = None) -> None:
    """Runs a function for its effects, at once."""
    using = _instance(resolve("output_transformer", using))
    map_partitions(_source(df, spark), _Silent(using) if not isinstance(using, Transformer) else using, NOTHING, params, partition, callback, ignore_errors).write.format("noop").mode("overwrite").save()


class _Silent:
    """A function whose result is dropped, be it a generator, with the same signature."""

    def __init__(self, fn: Callable):
        self.fn = fn
        self.__name__ = getattr(fn, "__name__", str(fn))
        self.__signature__ = inspect.signature(fn)
        self.__annotations__ = {k: v for k, v in typing.get_type_hints(fn).items() if k != "return"} | {"return": None}
        self.rules = rules_of(fn)

    def __call__(self, *args: Any, **kwargs: Any) -> None:
        result = self.fn(*args, **kwargs)
        if isinstance(result, Iterator):
            for _ in result:
                pass


@dataclass
class Zipped:
    """Several frames that a cotransformation takes together, by keys."""

    dfs: list[DataFrame]
    names: list[str] | None
    how: str
    spec: PartitionSpec


def zip_frames(dfs: Any, how: str = "inner", partition: Any = None) -> Zipped:
    """how tells which keys take part: inner those of all frames, left_outer of the first, right_outer of the last,
    full_outer of any; cross has no keys. Keys are the spec's or the common columns."""
    names = list(dfs) if isinstance(dfs, dict) else None
    frames = list(dfs.values()) if isinstance(dfs, dict) else list(dfs)
    spec, kind = partition_spec(partition), join_kind(how)
    if kind not in ("inner", "left_outer", "right_outer", "full_outer", "cross"):
        raise NotImplementedError(f"zip by {how}")
    if not frames:
        raise ValueError("no frames")
    if kind == "cross":
        if spec.by:
            raise SchemaError("a cross zip has no keys")
    elif not spec.by:
        common = [c for c in frames[0].columns if all(c in d.columns for d in frames[1:])]
        if not common or len(frames) == 1:
            raise SchemaError("no common columns to zip by")
        spec = with_keys(spec, tuple(common))
    for d in frames:
        need(d, list(spec.by))
    return Zipped(frames, names, kind, spec)


def _present(kind: str, sizes: list[int]) -> bool:
    if kind == "left_outer":
        return sizes[0] > 0
    if kind == "right_outer":
        return sizes[-1] > 0
    return any(sizes) if kind == "full_outer" else all(sizes)


def cotransform(zipped: Zipped, using: Any, schema: Any = None, params: dict[str, Any] | None = None, callback: Callable | None = None, ignore_errors: Any = None) -> DataFrame:
    """Runs a function over the frames of each key; a missing side is an empty frame.

    All frames meet in one shuffle: each row carries its frame's number and its columns as one struct.
    """
    using, params = _instance(resolve("cotransformer", using)), params or {}
    spec, names, kind = zipped.spec, zipped.names, zipped.how
    rules = rules_of(using)
    check_partition(rules, spec)
    schemas = [d.schema for d in zipped.dfs]
    if isinstance(using, CoTransformer):
        using.params, using.partition = params, spec
        schema = schema if schema is not None else using.get_output_schema(dict(zip(names, schemas, strict=True)) if names else schemas)
    else:
        s = Signature.read(using)
        s.check_params(params, using)
        if not (len(s.frames) == 1 and s.frames[0][1].startswith("frames")) and len(s.frames) != len(schemas):
            raise ValidationError(f"{getattr(using, '__name__', using)} takes {len(s.frames)} frames, not {len(schemas)}")
        schema = schema if schema is not None else declared_schema(using)
        if schema is None and s.output == "none":
            schema = NOTHING
    if schema is None:
        raise SchemaError("the output schema is not declared")
    no_wildcard(schema)
    out = transform_schema(schemas[0], schema)
    call = _Call(using, params, tuple(ignore_errors or ()), schemas[0], spec, remote(zipped.dfs[0].sparkSession, callback) if callback else None, out)

    def part(i: int, df: DataFrame) -> DataFrame:
        payload: list[Column] = [(F.struct(*map(ref, df.columns)) if i == j else F.lit(None).cast(s)).alias(f"__{j}") for j, s in enumerate(schemas)]
        return _without_nan(df, spec.by).select(*map(ref, spec.by), F.lit(i).alias("__no"), *payload)

    together = reduce(DataFrame.union, [part(i, d) for i, d in enumerate(zipped.dfs)])
    arrows, want = [arrow_schema(s) for s in schemas], arrow_schema(out)

    def over_group(key: tuple, table: pa.Table) -> pa.Table:
        no = table.column("__no").to_numpy()
        groups = []
        for i, s in enumerate(arrows):
            own = table.filter(pa.array(no == i)).column(f"__{i}").combine_chunks()
            own = pa.concat_arrays(own.chunks) if isinstance(own, pa.ChunkedArray) else own
            columns = [own.field(n) for n in range(len(s))] if len(own) else None
            groups.append(ordered(pa.table([c.cast(f.type) for c, f in zip(columns, s, strict=True)], schema=s) if columns else s.empty_table(), {k: v for k, v in spec.presort.items() if k in s.names}))
        if not _present(kind, [g.num_rows for g in groups]):
            return want.empty_table()
        found = list(call.many(tuple(k.as_py() for k in key), groups, names))
        return pa.concat_tables(found) if found else want.empty_table()

    return together.groupBy(*map(ref, spec.by)).applyInArrow(over_group, out)


def out_cotransform(zipped: Zipped, using: Any, params: dict[str, Any] | None = None, callback: Callable | None = None, ignore_errors: Any = None) -> None:
    using = _instance(resolve("output_transformer", using))
    cotransform(zipped, using if isinstance(using, CoTransformer) else _Silent(using), NOTHING, params, callback, ignore_errors).write.format("noop").mode("overwrite").save()

