"""Extended SQL: scripts of SELECT statements and of the operators' own statements, laid out as a pipeline.

Statements need no separator. Each starts with its keyword, in any case, or with "name = ". A SELECT goes to Spark as
text in which the script's frames are spliced in; it ends where the next statement or a suffix begins.
"""

from __future__ import annotations

import ast
import inspect
import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import SchemaError, SqlSyntaxError
from ..operators.extensions import resolve
from ..operators.partition import PartitionSpec, partition_spec
from ..schema import _Reader
from .flow import Flow, FlowFrame, FlowResult, FlowZip

_TOKEN = re.compile(r"(?P<blank>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\")|(?P<tick>`(?:[^`]|``)*`)|(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d]\w*)|(?P<sign>:=|<=>|<>|!=|<=|>=|\|\||::|->|.)", re.S)

STARTS = {"SELECT", "WITH", "CREATE", "LOAD", "SAVE", "TRANSFORM", "OUTTRANSFORM", "PROCESS", "OUTPUT", "ZIP", "PRINT", "RENAME", "ALTER", "DROP", "FILL", "SAMPLE", "TAKE", "SUB", "CONNECT"}
ALGOS = {"HASH", "RAND", "EVEN", "COARSE", "DEFAULT"}
SET_OPS = {"UNION": "union", "EXCEPT": "subtract", "MINUS": "subtract", "INTERSECT": "intersect"}
#: Words that end a FROM list or cannot be an alias.
CLAUSES = {"WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "EXCEPT", "MINUS", "INTERSECT", "WINDOW", "LATERAL", "PIVOT", "UNPIVOT", "CLUSTER", "DISTRIBUTE", "SORT", "QUALIFY"}
JOINS = {"JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "SEMI", "ANTI", "NATURAL", "ON", "USING", "TABLESAMPLE", "OUTER"}
HOW = {"INNER": "inner", "CROSS": "cross", "LEFT": "left_outer", "RIGHT": "right_outer", "FULL": "full_outer"}


class _Token:
    __slots__ = ("kind", "text", "at", "end")

    def __init__(self, kind: str, text: str, at: int, end: int):
        self.kind, self.text, self.at, self.end = kind, text, at, end

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text if self.kind == "sign" else ""


def tokens_of(text: str) -> list[_Token]:
    return [_Token(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup != "blank"]


def fill_template(text: str, params: dict[str, Any]) -> str:
    """{{name}} becomes a parameter's text; jinja2 does it all where it is installed."""
    if "{{" not in text and "{%" not in text:
        return text
    try:
        import jinja2
    except ImportError:

        def put(m: re.Match) -> str:
            if m[1] not in params:
                raise SqlSyntaxError(f"no parameter {m[1]}")
            return str(params[m[1]])

        return re.sub(r"\{\{\s*(\w+)\s*\}\}", put, text)
    return jinja2.Template(text).render(**params)


class Script:
    """Lays one script out on a pipeline."""

    def __init__(self, text: str, flow: Flow, frames: dict[str, Any], scope: dict[str, Any]):
        self.text, self.flow, self.scope = text, flow, scope
        self.frames: dict[str, Any] = dict(frames)
        self.tokens, self.at = tokens_of(text), 0
        self.last: Any = None
        self.unnamed = 0

    # Reading

    def peek(self, n: int = 0) -> str:
        i = self.at + n
        return self.tokens[i].up if i < len(self.tokens) else ""

    def fail(self, what: str) -> SqlSyntaxError:
        t = self.tokens[self.at] if self.at < len(self.tokens) else None
        place = t.at if t else len(self.text)
        line = self.text.count("\n", 0, place) + 1
        return SqlSyntaxError(f"{what} in line {line}: {self.text[place : place + 40]!r}")

    def take(self, *words: str) -> bool:
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise self.fail(f"{' '.join(words)} expected")

    def token(self, *kinds: str) -> _Token:
        if self.at >= len(self.tokens) or self.tokens[self.at].kind not in kinds:
            raise self.fail(f"{' or '.join(kinds)} expected")
        self.at += 1
        return self.tokens[self.at - 1]

    def name(self) -> str:
        t = self.token("word", "tick")
        return t.text[1:-1].replace("``", "`") if t.kind == "tick" else t.text

    def dotted(self) -> str:
        out = self.name()
        while self.take("."):
            out += "." + self.name()
        return out

    def names(self) -> list[str]:
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        return out

    def string(self) -> str:
        return ast.literal_eval(self.token("text").text)

    def value(self) -> Any:
        """A literal, a list or a dict."""
        if self.take("["):
            out: list[Any] = []
            while not self.take("]"):
                out.append(self.value())
                self.take(",")
            return out
        if self.take("{"):
            found: dict[str, Any] = {}
            while not self.take("}"):
                key = self.string() if self.tokens[self.at].kind == "text" else self.name()
                self.need(":")
                found[key] = self.value()
                self.take(",")
            return found
        if self.take("-"):
            return -self.value()
        if self.at < len(self.tokens) and self.tokens[self.at].kind == "text":
            return self.string()
        if self.at < len(self.tokens) and self.tokens[self.at].kind == "number":
            return json.loads(self.token("number").text) if re.fullmatch(r"\d+", self.tokens[self.at].text) else float(self.token("number").text)
        word = self.name()
        known = {"TRUE": True, "FALSE": False, "NULL": None, "NONE": None}
        if word.upper() in known:
            return known[word.upper()]
        if word in self.scope:
            return self.scope[word]
        raise self.fail(f"unknown value {word}")

    def params(self) -> dict[str, Any]:
        """(a=1, b:"x"), PARAMS a=1,b=2 or a JSON object; nothing."""
        if self.take("PARAMS"):
            if self.peek() == "{":
                return self.value()
            return self._pairs("")
        if self.peek() == "(":
            self.need("(")
            return self._pairs(")")
        return self.value() if self.peek() == "{" else {}

    def _pairs(self, close: str) -> dict[str, Any]:
        out: dict[str, Any] = {}
        while not close or not self.take(close):
            key = self.string() if self.tokens[self.at].kind == "text" else self.name()
            if not self.take("=") and not self.take(":"):
                raise self.fail("= expected")
            out[key] = self.value()
            if not self.take(",") and not close:
                break
        return out

    def schema(self) -> str:
        """The text of a schema or of a change of one, as far as it goes."""
        if self.tokens[self.at].kind == "text":
            return self.string()
        start = self.tokens[self.at].at
        reader = _Reader(self.text)
        reader.at = start
        while True:
            mark = reader.at
            try:
                if reader.take("*"):
                    pass
                elif reader.peek() in ("+", "-", "~"):
                    sign = reader.peek()
                    reader.take(sign)
                    while True:
                        reader.name()
                        if sign == "+":
                            reader.need(":")
                            reader.kind()
                        mark = reader.at
                        if not reader.take(","):
                            break
                else:
                    reader.name()
                    reader.need(":")
                    reader.kind()
            except SchemaError:
                reader.at = mark
                break
            mark = reader.at
            if reader.take(","):
                continue
            if reader.peek() not in ("+", "-", "~"):
                break
        reader.at = mark
        if mark == start:
            raise self.fail("a schema expected")
        while self.at < len(self.tokens) and self.tokens[self.at].at < mark:
            self.at += 1
        return self.text[start:mark]

    def order(self) -> list[tuple[str, bool]]:
        out = []
        while True:
            name = self.name()
            up = not self.take("DESC")
            self.take("ASC")
            out.append((name, up))
            if not self.take(","):
                return out

    def prepartition(self) -> PartitionSpec:
        """[algorithm] PREPARTITION [number] [BY keys] [PRESORT order], or PRESORT alone."""
        spec: dict[str, Any] = {}
        if self.peek() in ALGOS and self.peek(1) == "PREPARTITION":
            spec["algo"] = self.peek().lower()
            self.at += 1
        if self.take("PREPARTITION"):
            start = self.at
            depth = 0
            while self.at < len(self.tokens) and (depth or self.peek() not in ("BY", "PRESORT", "USING", "FROM", "TO", "OVERWRITE", "APPEND", "SINGLE") and not self._suffix() and (self.at == start or not self._starts())):
                depth += (self.peek() == "(") - (self.peek() == ")")
                self.at += 1
            if self.at > start:
                spec["num"] = self.text[self.tokens[start].at : self.tokens[self.at - 1].end].upper()
            if self.take("BY"):
                spec["by"] = self.names()
        if self.take("PRESORT"):
            spec["presort"] = self.order()
        return partition_spec(spec)

    # Frames

    def _starts(self, at: int | None = None) -> bool:
        """Whether a statement starts here."""
        at = self.at if at is None else at
        up = lambda i: self.tokens[i].up if 0 <= i < len(self.tokens) else ""
        if at >= len(self.tokens):
            return False
        t = self.tokens[at]
        if t.kind in ("word", "tick") and up(at + 1) in ("=", ":=") and (up(at + 2) in STARTS and up(at + 2) != "" or up(at + 2) == "(" and up(at + 3) in STARTS) and up(at - 1) not in ("WHERE", "ON", "AND", "OR", "NOT", ",", ".", "HAVING"):
            return True
        word, following, before = t.up, up(at + 1), up(at - 1)
        if word not in STARTS or before in (".", ",", "AS") or following in (".", ",", ")"):
            return False
        if word in ("SELECT", "WITH"):
            return True
        nxt = self.tokens[at + 1] if at + 1 < len(self.tokens) else None
        return {
            "CREATE": following in ("USING", "["),
            "LOAD": bool(nxt) and (nxt.kind == "text" or nxt.kind == "word" and at + 2 < len(self.tokens) and self.tokens[at + 2].kind == "text"),
            "SAVE": True, "TRANSFORM": True, "OUTTRANSFORM": True, "PROCESS": True, "OUTPUT": True, "ZIP": True,
            "PRINT": True, "RENAME": following == "COLUMNS", "ALTER": following == "COLUMNS", "DROP": following in ("COLUMNS", "ROWS"),
            "FILL": following == "NULLS", "SAMPLE": following == "REPLACE" or bool(nxt) and nxt.kind == "number", "TAKE": bool(nxt) and nxt.kind == "number" or following in ("ROW", "ROWS"),
            "SUB": True, "CONNECT": True,
        }[word]

    def _suffix(self) -> bool:
        word, following = self.peek(), self.peek(1)
        return (
            word in ("PERSIST", "CHECKPOINT", "BROADCAST")
            or word == "LAZY" and following in ("PERSIST", "CHECKPOINT", "STRONG", "DETERMINISTIC", "WEAK")
            or word in ("STRONG", "WEAK") and following == "CHECKPOINT"
            or word == "DETERMINISTIC" and following == "CHECKPOINT"
            or word == "YIELD" and following in ("LOCAL", "DATAFRAME", "FILE", "TABLE")
        )

    def frame(self, name: str) -> Any:
        if name not in self.frames:
            raise self.fail(f"unknown frame {name}")
        found = self.frames[name]
        if isinstance(found, DataFrame) or not isinstance(found, (FlowFrame, FlowZip, dict, list, tuple)):
            found = self.frames[name] = self.flow.df(found)
        return found

    def operand(self) -> FlowFrame:
        """A frame by name, one of several by index, or a statement in brackets."""
        if self.take("("):
            out = self.statement()
            self.need(")")
            return out
        found = self.frame(self.name())
        while self.take("["):
            key = self.token("number", "text", "word")
            self.need("]")
            if isinstance(found, (list, tuple)):
                found = found[int(key.text)]
            elif key.kind == "number":
                found = list(found.values())[int(key.text)]
            else:
                found = found[ast.literal_eval(key.text) if key.kind == "text" else key.text]
        return found

    def operands(self, stops: tuple[str, ...]) -> tuple[list[FlowFrame], list[str] | None]:
        """Frames before a keyword, all with or all without names; the last one if there are none."""
        if self.peek() in stops or self.peek() in ALGOS and self.peek(1) == "PREPARTITION" or self.at >= len(self.tokens) or self._suffix() or self._starts():
            return [self.previous()], None
        frames, names = [], []
        while True:
            if self.peek(1) in ("=", ":"):
                names.append(self.name())
                self.at += 1
            frames.append(self.operand())
            if not self.take(","):
                break
        if len(frames) == 1 and isinstance(frames[0], (dict, list, tuple)):
            held = frames[0]
            return (list(held.values()), list(held)) if isinstance(held, dict) else (list(held), None)
        return frames, names or None

    def previous(self) -> Any:
        if self.last is None:
            raise self.fail("no frame before this statement")
        return self.last

    def from_frame(self) -> FlowFrame:
        return self.operand() if self.take("FROM") else self.previous()

    # Statements

    def run(self) -> None:
        while self.at < len(self.tokens):
            if self.take(";"):
                continue
            self.task()

    def task(self) -> None:
        name = None
        if self.peek(1) in ("=", ":="):
            name = self.name()
            self.at += 1
        elif self.peek(1) == "?" and self.peek(2) == "=":
            name = self.name()
            self.at += 2
        out = self.statement()
        if out is not None:
            self.last = out
        if name is not None:
            if out is None:
                raise self.fail("this statement gives no frame")
            self.frames[name] = out
        if isinstance(out, FlowFrame):
            self.suffixes(out, name)

    def statement(self) -> Any:
        if self.take("("):
            out = self.statement()
            self.need(")")
        else:
            if not self._starts():
                if self.tokens[self.at].kind in ("word", "tick") and self.tokens[self.at].text.strip("`") in self.frames:
                    return self.operand()
                raise self.fail("a statement expected")
            out = getattr(self, f"do_{self.peek().lower()}")()
        while self.peek() in SET_OPS and isinstance(out, FlowFrame):
            how = SET_OPS[self.peek()]
            self.at += 1
            distinct = not self.take("ALL")
            self.take("DISTINCT")
            other = self.statement()
            out = out.set_op(how, other, distinct=distinct)
        return out

    def suffixes(self, out: FlowFrame, name: str | None) -> None:
        while self._suffix():
            lazy = self.take("LAZY")
            if self.take("PERSIST"):
                options = self.params() if self.peek() == "(" else {}
                out.persist(lazy, options.get("level"))
            elif self.take("WEAK", "CHECKPOINT"):
                out.weak_checkpoint(lazy)
            elif self.take("STRONG", "CHECKPOINT") or self.take("CHECKPOINT"):
                options = self.params() if self.peek() == "(" else {}
                out.strong_checkpoint(lazy=lazy, **options)
            elif self.take("DETERMINISTIC", "CHECKPOINT"):
                space = self.string() if self.at < len(self.tokens) and self.tokens[self.at].kind == "text" else None
                spec = self.prepartition()
                single = self.take("SINGLE")
                options = self.params() if self.peek() == "(" else {}
                out.deterministic_checkpoint(lazy=lazy, namespace=space, partition=spec, single=single, **options)
            elif self.take("BROADCAST"):
                out.broadcast()
            else:
                self.need("YIELD")
                local = self.take("LOCAL")
                kind = self.token("word").up
                given = self.name() if self.take("AS") else name
                if given is None:
                    raise self.fail("a name to yield by expected")
                if kind == "DATAFRAME":
                    out.yield_dataframe_as(given, local)
                elif kind == "FILE":
                    out.yield_file_as(given)
                else:
                    out.yield_table_as(given)

    def _body_end(self) -> int:
        """Where a SELECT that starts here ends."""
        i, depth, first = self.at, 0, True
        with_open = self.peek() == "WITH"
        save = self.at
        while i < len(self.tokens):
            up = self.tokens[i].up
            if up in ("(", "["):
                depth += 1
            elif up in (")", "]"):
                if not depth:
                    break
                depth -= 1
            elif not depth and not first:
                before = self.tokens[i - 1].up
                if up == ";":
                    break
                self.at = i
                ends = self._suffix()
                if not ends and self._starts():
                    if up == "SELECT" and (with_open or before in ("ALL", "DISTINCT", *SET_OPS)):
                        with_open = False
                    else:
                        ends = True
                if not ends and up in SET_OPS:
                    n = 2 if self.peek(1) in ("ALL", "DISTINCT") else 1
                    j = i + n + (self.peek(n) == "(")
                    ends = self._starts(j) and self.tokens[j].up not in ("SELECT", "WITH")
                self.at = save
                if ends:
                    break
            first = False
            i += 1
        self.at = save
        return i

    def do_select(self) -> FlowFrame:
        end = self._body_end()
        parts: list[str] = []
        used: dict[str, FlowFrame] = {}
        depth, in_from = 0, {0: False}
        saw_from = False
        place = self.tokens[self.at].at
        last_up = ""
        ctes: set[str] = set()

        def literal(upto: int) -> None:
            nonlocal place
            parts.append(self.text[place:upto].replace("{", "{{").replace("}", "}}"))
            place = upto

        def splice(t: _Token, stop: int, frame: FlowFrame, alias: str) -> None:
            nonlocal place
            literal(t.at)
            key = next((k for k, f in used.items() if f.step is frame.step), f"f{len(used)}_")
            used[key] = frame
            parts.append("{" + key + "}" + alias)
            place = stop

        i = self.at
        insert_at: int | None = None
        while i < end:
            t = self.tokens[i]
            up = t.up
            if up == "(":
                depth += 1
                in_from[depth] = False
                if last_up in ("FROM", "JOIN") or last_up == "," and in_from.get(depth - 1):
                    self.at = i + 1
                    if self._starts() and self.peek() not in ("SELECT", "WITH"):
                        out = self.statement()
                        self.need(")")
                        i = self.at
                        has_alias = i < end and (self.tokens[i].up == "AS" or self.tokens[i].kind in ("word", "tick") and self.tokens[i].up not in CLAUSES | JOINS)
                        splice(t, self.tokens[i - 1].end, out, "" if has_alias else f" AS t{len(used)}_")
                        depth -= 1
                        last_up = ")"
                        continue
            elif up == ")":
                depth -= 1
            elif up == "FROM" and not self._inside_function(i, depth):
                in_from[depth] = True
                saw_from = saw_from or depth == 0
            elif up in CLAUSES:
                in_from[depth] = False
                if depth == 0 and not saw_from and insert_at is None and up != "WINDOW":
                    insert_at = i
            elif up == "AS" and i + 1 < end and self.tokens[i + 1].up == "(" and i and self.tokens[i - 1].kind in ("word", "tick"):
                ctes.add(self.tokens[i - 1].text.strip("`"))
            elif t.kind in ("word", "tick") and (last_up in ("FROM", "JOIN") or last_up == "," and in_from.get(depth)):
                name = t.text.strip("`")
                after = self.tokens[i + 1].up if i + 1 < end else ""
                if name in self.frames and name not in ctes and after not in (".", "("):
                    self.at = i
                    stop_at = i + 1
                    frame = self.operand()
                    stop_at, self.at = self.at, i
                    following = self.tokens[stop_at] if stop_at < end else None
                    has_alias = following is not None and (following.up == "AS" or following.kind in ("word", "tick") and following.up not in CLAUSES | JOINS)
                    splice(t, self.tokens[stop_at - 1].end, frame, "" if has_alias else f" AS {quote_sql(name)}")
                    i = stop_at
                    last_up = name
                    continue
            last_up = up or t.text
            i += 1
        stop = self.tokens[end - 1].end
        if not saw_from and self.last is not None and isinstance(self.last, FlowFrame):
            # A SELECT without FROM reads the last frame.
            key = next((k for k, f in used.items() if f.step is self.last.step), "last_")
            used[key] = self.last
            literal(stop)
            text = "".join(parts)
            cut = self._clause_at(text)
            text = f"{text[:cut].rstrip()} FROM {{{key}}} AS last_ {text[cut:]}".rstrip()
        else:
            literal(stop)
            text = "".join(parts)
        self.at = end
        return self.flow.sql(text, **used)

    do_with = do_select

    def _inside_function(self, i: int, depth: int) -> bool:
        """FROM in EXTRACT(x FROM y), SUBSTRING(x FROM y), TRIM(x FROM y) or IS DISTINCT FROM."""
        if i and self.tokens[i - 1].up == "DISTINCT" and i > 1 and self.tokens[i - 2].up in ("IS", "NOT"):
            return True
        level = 0
        for j in range(i - 1, -1, -1):
            up = self.tokens[j].up
            if up == ")":
                level += 1
            elif up == "(":
                if not level:
                    return j > 0 and self.tokens[j - 1].up in ("EXTRACT", "SUBSTRING", "SUBSTR", "TRIM", "OVERLAY")
                level -= 1
        return False

    @staticmethod
    def _clause_at(text: str) -> int:
        """Where in a SELECT without FROM its FROM belongs."""
        depth = 0
        for t in tokens_of(text):
            depth += (t.up == "(") - (t.up == ")")
            if not depth and t.up in CLAUSES:
                return t.at
        return len(text)

    def do_connect(self) -> FlowFrame:
        self.need("CONNECT")
        engine = self.name().lower()
        if engine not in ("spark", "sparksql"):
            raise self.fail(f"unknown engine {engine}")
        return self.do_select()

    def do_create(self) -> FlowFrame:
        self.need("CREATE")
        if self.take("USING"):
            using = resolve("creator", self.dotted(), self.scope)
            params = self.params()
            return self.flow.create(using, self.schema() if self.take("SCHEMA") else None, params)
        data = self.value()
        self.need("SCHEMA")
        return self.flow.df(data, self.schema())

    def do_load(self) -> FlowFrame:
        self.need("LOAD")
        fmt = self.name() if self.tokens[self.at].kind == "word" else None
        path = self.value()
        params = self.params()
        columns = None
        if self.take("COLUMNS"):
            columns = self.schema() if self.peek(1) == ":" or self.tokens[self.at].kind == "text" else self.names()
        return self.flow.load(path, fmt, columns, **params)

    def do_save(self) -> Any:
        self.need("SAVE")
        use = self.take("AND", "USE")
        frames, _ = self.operands(("PREPARTITION", "TO", "OVERWRITE", "APPEND"))
        spec = self.prepartition()
        modes = {"TO": "error", "OVERWRITE": "overwrite", "APPEND": "append"}
        if self.peek() not in modes:
            raise self.fail("TO, OVERWRITE or APPEND expected")
        mode = modes[self.peek()]
        self.at += 1
        single = self.take("SINGLE")
        fmt = self.name() if self.tokens[self.at].kind == "word" else None
        path = self.string()
        params = self.params()
        frame = frames[0].partition(spec)
        if use:
            return frame.save_and_use(path, fmt, mode, single, **params)
        frame.save(path, fmt, mode, single, **params)
        return None

    def _using(self) -> str:
        self.need("USING")
        out = self.dotted()
        if self.take(":"):
            out += ":" + self.dotted()
        return out

    def do_transform(self) -> FlowFrame:
        self.need("TRANSFORM")
        frames, names = self.operands(("PREPARTITION", "PRESORT", "USING"))
        spec = self.prepartition()
        using, params = self._using(), self.params()
        schema = self.schema() if self.take("SCHEMA") else None
        ignore = [self.scope.get(n, getattr(__import__("builtins"), n, None)) for n in self.names()] if self.take("IGNORE", "ERRORS") else None
        callback = self.scope[self.name()] if self.take("CALLBACK") else None
        if isinstance(frames[0], FlowZip):
            return frames[0].transform(resolve("cotransformer", using, self.scope), schema, params, callback, ignore)
        return frames[0].partition(spec).transform(resolve("transformer", using, self.scope), schema, params, None, callback, ignore)

    def do_outtransform(self) -> None:
        self.need("OUTTRANSFORM")
        frames, names = self.operands(("PREPARTITION", "PRESORT", "USING"))
        spec = self.prepartition()
        using, params = resolve("output_transformer", self._using(), self.scope), self.params()
        ignore = [self.scope.get(n, getattr(__import__("builtins"), n, None)) for n in self.names()] if self.take("IGNORE", "ERRORS") else None
        callback = self.scope[self.name()] if self.take("CALLBACK") else None
        if isinstance(frames[0], FlowZip):
            frames[0].out_transform(using, params, callback, ignore)
        else:
            frames[0].partition(spec).out_transform(using, params, None, callback, ignore)

    def do_process(self) -> FlowFrame:
        self.need("PROCESS")
        frames, names = self.operands(("PREPARTITION", "PRESORT", "USING"))
        spec = self.prepartition()
        using, params = resolve("processor", self._using(), self.scope), self.params()
        schema = self.schema() if self.take("SCHEMA") else None
        return self.flow.process(frames[0].partition(spec), *frames[1:], using=using, schema=schema, params=params, names=names)

    def do_output(self) -> None:
        self.need("OUTPUT")
        frames, names = self.operands(("PREPARTITION", "PRESORT", "USING"))
        spec = self.prepartition()
        using, params = resolve("outputter", self._using(), self.scope), self.params()
        self.flow.output(frames[0].partition(spec), *frames[1:], using=using, params=params, names=names)

    def do_zip(self) -> FlowZip:
        self.need("ZIP")
        frames, names = self.operands(())
        how = "inner"
        if self.peek() in HOW:
            how = HOW[self.peek()]
            self.at += 1
            self.take("OUTER")
        spec: dict[str, Any] = {}
        if self.take("BY"):
            spec["by"] = self.names()
        if self.take("PRESORT"):
            spec["presort"] = self.order()
        return FlowZip(frames, names, how, partition_spec(spec))

    def do_print(self) -> None:
        self.need("PRINT")
        n = 10
        if self.at < len(self.tokens) and self.tokens[self.at].kind == "number":
            n = int(self.token("number").text)
            if not self.take("ROWS"):
                self.need("ROW")
        self.take("FROM")
        frames, _ = self.operands(("ROWCOUNT", "TITLE", ";"))
        count = self.take("ROWCOUNT")
        title = self.string() if self.take("TITLE") else None
        for f in frames:
            f.show(n, count, title)

    def do_rename(self) -> FlowFrame:
        self.need("RENAME", "COLUMNS")
        names: dict[str, str] = {}
        while True:
            old = self.name()
            self.need(":")
            names[old] = self.name()
            if not self.take(","):
                break
        return self.from_frame().rename(names)

    def do_alter(self) -> FlowFrame:
        self.need("ALTER", "COLUMNS")
        columns = self.schema()
        return self.from_frame().alter_columns(columns)

    def do_drop(self) -> FlowFrame:
        self.need("DROP")
        if self.take("COLUMNS"):
            columns = self.names()
            there = self.take("IF", "EXISTS")
            return self.from_frame().drop(columns, there)
        self.need("ROWS", "IF")
        how = self.token("word").text.lower()
        if not self.take("NULLS"):
            self.need("NULL")
        subset = self.names() if self.take("ON") else None
        return self.from_frame().dropna(how, None, subset)

    def do_fill(self) -> FlowFrame:
        self.need("FILL", "NULLS")
        values = self.params()
        return self.from_frame().fillna(values)

    def do_sample(self) -> FlowFrame:
        self.need("SAMPLE")
        replace = self.take("REPLACE")
        n = self.value()
        by: dict[str, Any] = {"frac": n / 100} if self.take("PERCENT") else {}
        if not by:
            if not self.take("ROWS"):
                self.need("ROW")
            by = {"n": int(n)}
        seed = int(self.token("number").text) if self.take("SEED") else None
        return self.from_frame().sample(replace=replace, seed=seed, **by)

    def do_take(self) -> FlowFrame:
        self.need("TAKE")
        n = int(self.token("number").text) if self.tokens[self.at].kind == "number" else 20
        if not self.take("ROWS"):
            self.need("ROW")
        frame = self.from_frame()
        spec = self.prepartition()
        na = "last"
        if self.take("NULLS"):
            na = self.token("word").text.lower()
        return frame.partition(spec).take(n, "" if spec.by else list(spec.presort.items()), na)

    def do_sub(self) -> Any:
        self.need("SUB")
        frames, names = self.operands(("USING",))
        module = resolve("module", self._using(), self.scope)
        params = self.params()
        takes = list(inspect.signature(module).parameters)
        given = [self.flow] if takes and takes[0] in ("flow", "wf", "workflow") else []
        return module(*given, **dict(zip(names, frames, strict=True)), **params) if names else module(*given, *frames, **params)


def quote_sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _is_frame(value: Any) -> bool:
    import pandas as pd
    import pyarrow as pa

    return isinstance(value, (DataFrame, FlowFrame, pd.DataFrame, pa.Table))


def xsql_flow(text: str, *args: dict[str, Any], scope: dict[str, Any] | None = None, **params: Any) -> ScriptFlow:
    """The pipeline of a script. Frames among the parameters and in the caller's scope are tables, functions are
    extensions, and everything may fill the template."""
    if scope is None:
        caller = inspect.currentframe().f_back
        scope = {**caller.f_globals, **caller.f_locals}
    every = {k: v for a in args for k, v in a.items()} | params
    names = scope | every
    flow = Flow()
    frames = {k: v for k, v in names.items() if _is_frame(v)}
    script = Script(fill_template(text, names), flow, frames, names)
    script.run()
    return ScriptFlow(flow, script)


class ScriptFlow:
    """A laid out script, to be run as often as needed."""

    def __init__(self, flow: Flow, script: Script):
        self.flow, self.script = flow, script

    def run(self, spark: SparkSession | None = None, **conf: Any) -> FlowResult:
        return self.flow.run(spark, **conf)

    def spec_uuid(self) -> str:
        return self.flow.spec_uuid()


def xsql(text: str, *args: dict[str, Any], spark: SparkSession | None = None, scope: dict[str, Any] | None = None, conf: dict[str, Any] | None = None, **params: Any) -> Any:
    """Runs a script and gives its last frame, or None if it has none."""
    if scope is None:
        caller = inspect.currentframe().f_back
        scope = {**caller.f_globals, **caller.f_locals}
    laid = xsql_flow(text, *args, scope=scope, **params)
    last = laid.script.last
    result = laid.flow._run(spark, conf or {}, isinstance(last, FlowFrame))  # the frame may read copies later
    return result.frames[last.step] if isinstance(last, FlowFrame) else None


def load_ipython_extension(shell: Any) -> None:
    """Gives a notebook the cell magic %%xsql: the cell is a script over the notebook's frames and functions, whose last
    frame it shows; %%xsql name also keeps that frame under a name."""

    def magic(line: str, cell: str) -> Any:
        out = xsql(cell, scope=dict(shell.user_ns))
        if line.strip():
            shell.user_ns[line.strip()] = out
        if out is None:
            return None
        from ..operators.output import to_html

        return _Shown(to_html(out))

    shell.register_magic_function(magic, "cell", "xsql")


class _Shown:
    """What a notebook displays as HTML."""

    def __init__(self, html: str):
        self.html = html

    def _repr_html_(self) -> str:
        return self.html


def raw_sql(*parts: Any, spark: SparkSession | None = None) -> DataFrame:
    """Texts and frames in turn, as one SELECT: raw_sql("SELECT * FROM", df, "WHERE a > 1")."""
    text, frames = [], {}
    for p in parts:
        if isinstance(p, str):
            text.append(p.replace("{", "{{").replace("}", "}}"))
        else:
            key = next((k for k, f in frames.items() if f is p), f"f{len(frames)}_")
            frames[key] = p
            text.append("{" + key + "}")
    first = next((f for f in frames.values() if isinstance(f, DataFrame)), None)
    session = spark or (first.sparkSession if first is not None else SparkSession.builder.getOrCreate())
    return session.sql(" ".join(text), **frames)


