"""Extensions: classes, decorated or plain functions that a pipeline calls, a registry of their names, and their rules."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import SchemaError, ValidationError
from ..schema import format_type, parse_schema
from .partition import PartitionSpec
from .relational import parse_presort

RULES = ("partitionby_has", "partitionby_is", "presort_has", "presort_is", "input_has", "input_is")
KINDS = ("transformer", "output_transformer", "cotransformer", "output_cotransformer", "creator", "processor", "outputter", "module")


class Extension:
    """What all class extensions know when they run."""

    params: dict[str, Any] = {}
    partition: PartitionSpec = PartitionSpec()
    callback: Callable | None = None
    key_schema: T.StructType | None = None
    output_schema: T.StructType | None = None
    rules: dict[str, Any] = {}


class Transformer(Extension):
    """Over each logical partition, on a worker. input_format and the result are "pandas" or "arrow" frames."""

    input_format = "pandas"

    def get_output_schema(self, schema: T.StructType) -> Any:
        raise NotImplementedError

    def on_init(self, schema: T.StructType) -> None:
        """Once for each physical partition, on its worker."""

    def transform(self, df: Any) -> Any:
        raise NotImplementedError


class OutputTransformer(Transformer):
    """The same without a result."""

    def process(self, df: Any) -> None:
        raise NotImplementedError

    def get_output_schema(self, schema: T.StructType) -> Any:
        return "_0:int"

    def transform(self, df: Any) -> Any:
        self.process(df)


class CoTransformer(Extension):
    """Over the frames of several inputs that share a key; a list by place, or a dict by name."""

    input_format = "pandas"

    def get_output_schema(self, schemas: Any) -> Any:
        raise NotImplementedError

    def on_init(self, schemas: Any) -> None:
        """Once for each group, on its worker."""

    def transform(self, dfs: Any) -> Any:
        raise NotImplementedError


class OutputCoTransformer(CoTransformer):
    def process(self, dfs: Any) -> None:
        raise NotImplementedError

    def get_output_schema(self, schemas: Any) -> Any:
        return "_0:int"

    def transform(self, dfs: Any) -> Any:
        self.process(dfs)


class Creator(Extension):
    """Makes a frame on the driver."""

    session: SparkSession

    def create(self) -> DataFrame:
        raise NotImplementedError


class Processor(Extension):
    """Makes a frame of frames on the driver."""

    session: SparkSession

    def process(self, dfs: Any) -> DataFrame:
        raise NotImplementedError


class Outputter(Extension):
    """Takes frames on the driver."""

    session: SparkSession

    def process(self, dfs: Any) -> None:
        raise NotImplementedError


_registry: dict[tuple[str, str], Any] = {}
_parsers: dict[str, list[Callable[[Any], Any]]] = {}


def register(kind: str, name: str, extension: Any, overwrite: bool = True) -> None:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    if not overwrite and (kind, name) in _registry:
        raise KeyError(f"{kind} {name} exists")
    _registry[kind, name] = extension


def register_parser(kind: str, parse: Callable[[Any], Any]) -> None:
    """parse turns an object into an extension, or gives None."""
    _parsers.setdefault(kind, []).append(parse)


def resolve(kind: str, using: Any, scope: dict[str, Any] | None = None) -> Any:
    """An extension by object, registered name, name in scope or dotted path."""
    for parse in _parsers.get(kind, []):
        if (found := parse(using)) is not None:
            return found
    if not isinstance(using, str):
        return using
    if (kind, using) in _registry:
        return _registry[kind, using]
    if scope and using in scope:
        return scope[using]
    if "." in using:
        module, _, name = using.rpartition(".")
        if scope and module in scope:
            return getattr(scope[module], name)
        try:
            return getattr(__import__(module, fromlist=[name]), name)
        except (ImportError, AttributeError) as e:
            raise ValidationError(f"no {kind} {using}") from e
    raise ValidationError(f"no {kind} {using}")


def register_transformer(name: str, extension: Any, overwrite: bool = True) -> None:
    register("transformer", name, extension, overwrite)


def register_output_transformer(name: str, extension: Any, overwrite: bool = True) -> None:
    register("output_transformer", name, extension, overwrite)


def register_creator(name: str, extension: Any, overwrite: bool = True) -> None:
    register("creator", name, extension, overwrite)


def register_processor(name: str, extension: Any, overwrite: bool = True) -> None:
    register("processor", name, extension, overwrite)


def register_outputter(name: str, extension: Any, overwrite: bool = True) -> None:
    register("outputter", name, extension, overwrite)


def _marked(kind: str, schema: Any = None, **rules: Any) -> Callable[[Callable], Callable]:
    unknown = set(rules) - set(RULES)
    if unknown:
        raise ValidationError(f"unknown rules {sorted(unknown)}")

    def mark(fn: Callable) -> Callable:
        fn.__lamina__ = {"kind": kind, "schema": schema, "rules": rules}
        return fn

    return mark


def transformer(schema: Any, **rules: Any) -> Callable[[Callable], Callable]:
    return _marked("transformer", schema, **rules)


def output_transformer(**rules: Any) -> Callable[[Callable], Callable]:
    return _marked("output_transformer", None, **rules)


def cotransformer(schema: Any, **rules: Any) -> Callable[[Callable], Callable]:
    return _marked("cotransformer", schema, **rules)


def output_cotransformer(**rules: Any) -> Callable[[Callable], Callable]:
    return _marked("output_cotransformer", None, **rules)


def creator(schema: Any = None) -> Callable[[Callable], Callable]:
    return _marked("creator", schema)


def processor(schema: Any = None, **rules: Any) -> Callable[[Callable], Callable]:
    return _marked("processor", schema, **rules)


def outputter(**rules: Any) -> Callable[[Callable], Callable]:
    return _marked("outputter", None, **rules)


def module(fn: Callable) -> Callable:
    """A function that lays out a part of a pipeline; SUB calls it by its name."""
    return _marked("module")(fn)


def register_module(name: str, fn: Callable, overwrite: bool = True) -> None:
    register("module", name, fn, overwrite)


def directives(fn: Any) -> dict[str, str]:
    """The directives "# schema: ..." and rules in the comment lines above a function; the last of a kind counts."""
    try:
        text = inspect.getcomments(fn) or ""
    except (TypeError, OSError):
        text = ""
    out: dict[str, str] = {}
    for line in text.splitlines():
        m = re.match(r"\s*#\s*(\w+)\s*:\s*(.*\S)\s*$", line)
        if m and m[1] in ("schema", *RULES):
            out[m[1]] = m[2]
    return out


def declared_schema(fn: Any) -> Any:
    mark = getattr(fn, "__lamina__", None)
    if mark and mark["schema"] is not None:
        return mark["schema"]
    return directives(fn).get("schema")


def rules_of(fn: Any) -> dict[str, Any]:
    given = {k: v for k, v in directives(fn).items() if k in RULES}
    mark = getattr(fn, "__lamina__", None)
    return given | (mark["rules"] if mark else {}) | dict(getattr(fn, "rules", {}) or {})


def _names(value: Any) -> list[str]:
    return [x.strip() for x in value.split(",") if x.strip()] if isinstance(value, str) else list(value)


def check_partition(rules: dict[str, Any], spec: PartitionSpec) -> None:
    """The rules that a pipeline's text can break."""
    for rule, value in rules.items():
        if rule.startswith("partitionby"):
            want = _names(value)
            fine = set(want) == set(spec.by) if rule.endswith("_is") else set(want) <= set(spec.by)
        elif rule.startswith("presort"):
            want, have = list(parse_presort(value).items()), list(spec.presort.items())
            fine = want == have if rule.endswith("_is") else all(w in have for w in want)
        else:
            continue
        if not fine:
            raise ValidationError(f"{rule} {value} is not met by keys {list(spec.by)} and order {spec.presort}")


def check_input(rules: dict[str, Any], schema: T.StructType) -> None:
    """The rules on columns; a rule may name types too."""
    have = {f.name: format_type(f.dataType) for f in schema.fields}
    if "input_has" in rules:
        for part in _names(rules["input_has"]):
            name, _, kind = part.partition(":")
            if name.strip() not in have or kind and format_type(parse_schema(f"x:{kind}").fields[0].dataType) != have[name.strip()]:
                raise ValidationError(f"the input has no {part}")
    if "input_is" in rules:
        want = parse_schema(rules["input_is"])
        if [(f.name, format_type(f.dataType)) for f in want.fields] != list(have.items()):
            raise ValidationError(f"the input is not {rules['input_is']}")


def no_wildcard(schema: Any) -> None:
    if isinstance(schema, str) and "*" in schema or isinstance(schema, list) and any("*" in str(s) for s in schema):
        raise SchemaError("several inputs leave the wildcard without meaning")


