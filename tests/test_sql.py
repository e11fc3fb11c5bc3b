import gc
from collections.abc import Callable
from typing import Any

import pandas as pd
import pytest
from pyspark.sql import DataFrame

from lamina import api
from lamina.errors import CompileError, SqlSyntaxError
from lamina.operators.output import frame, same


# schema: *,z:int
def add(df: pd.DataFrame, n: int = 1) -> pd.DataFrame:
    return df.assign(z=n)


def pair(p: pd.DataFrame, q: pd.DataFrame) -> list[list[Any]]:
    return [[len(p), len(q)]]


def joined(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y, "a")


@api.module
def merge(flow, a, b, k=""):
    return {"j": a.inner_join(b), k: a}


def make(n: int = 1) -> pd.DataFrame:
    return pd.DataFrame({"a": [n]})


X = "x = CREATE [[1, 2], [3, 4], [1, NULL]] SCHEMA a:int,b:int "


@pytest.mark.parametrize(
    "text,rows,schema",
    [
        (X, [[1, 2], [3, 4], [1, None]], "a:int,b:int"),
        (X + "SELECT *", [[1, 2], [3, 4], [1, None]], "a:int,b:int"),
        (X + "select a, sum(b) as s where b > 0 group by a having sum(b) > 3", [[3, 4]], "a:int,s:long"),
        (X + "y = SELECT a FROM x WHERE b IS NULL SELECT x.a, b FROM x JOIN y ON x.a = y.a AND b = 2", [[1, 2]], "a:int,b:int"),
        (X + "SELECT t.a FROM x AS t, x AS u WHERE t.a = u.a AND t.a = 3", [[3]], "a:int"),
        (X + "WITH q AS (SELECT a FROM x WHERE a = 3) SELECT * FROM q", [[3]], "a:int"),
        (X + "SELECT a FROM x UNION ALL SELECT b AS a FROM x WHERE b = 4", [[1], [3], [1], [4]], "a:int"),
        (X + "SELECT a FROM x EXCEPT SELECT 3 AS a", [[1]], "a:int"),
        (X + "SELECT * FROM (SELECT a FROM x) WHERE a IN (SELECT b - 1 FROM x)", [[3], [1], [1]], "a:int"),
        (X + "TRANSFORM x PREPARTITION BY a USING add(n=5)", [[1, 2, 5], [3, 4, 5], [1, None, 5]], "a:int,b:int,z:int"),
        (X + "TRANSFORM EVEN PREPARTITION ROWCOUNT/2 USING add SCHEMA *~b+z:int SELECT z, a", [[1, 1], [1, 3], [1, 1]], "z:int,a:int"),
        (X + "SELECT * FROM (TRANSFORM x USING add) WHERE z = 1 AND a = 3", [[3, 4, 1]], "a:int,b:int,z:int"),
        (X + "TAKE 1 ROW FROM x PREPARTITION BY a PRESORT b DESC NULLS FIRST", [[1, None], [3, 4]], "a:int,b:int"),
        (X + "TAKE 0 ROWS", [], "a:int,b:int"),
        (X + "RENAME COLUMNS a:aa,b:bb", [[1, 2], [3, 4], [1, None]], "aa:int,bb:int"),
        (X + "ALTER COLUMNS a:str FROM x", [["1", 2], ["3", 4], ["1", None]], "a:str,b:int"),
        (X + "DROP COLUMNS b, q IF EXISTS FROM x", [[1], [3], [1]], "a:int"),
        (X + "DROP ROWS IF ALL NULLS ON b FROM x", [[1, 2], [3, 4]], "a:int,b:int"),
        (X + "FILL NULLS (b:99) FROM x", [[1, 2], [3, 4], [1, 99]], "a:int,b:int"),
        (X + "FILL NULLS PARAMS b=99 FROM x", [[1, 2], [3, 4], [1, 99]], "a:int,b:int"),
        (X + "SAMPLE 100 PERCENT SEED 7 FROM x", [[1, 2], [3, 4], [1, None]], "a:int,b:int"),
        (X + "SAMPLE REPLACE 5 ROWS FROM x SELECT count(*) AS n", [[5]], "n:long"),
        (X + "y = CREATE [[1, 'q']] SCHEMA a:int,c:str ZIP x, y BY a TRANSFORM USING pair SCHEMA m:int,n:int", [[2, 1]], "m:int,n:int"),
        (X + "y = CREATE [[1, 'q']] SCHEMA a:int,c:str z = ZIP x, y LEFT OUTER TRANSFORM z USING pair SCHEMA m:int,n:int", [[2, 1], [1, 0]], "m:int,n:int"),
        (X + "y = CREATE [[3, 'q']] SCHEMA a:int,c:str PROCESS x, y USING joined", [[3, 4, "q"]], "a:int,b:int,c:str"),
        (X + "y = CREATE [[3, 'q']] SCHEMA a:int,c:str PROCESS y=y, x=(SELECT a FROM x) USING joined", [[3, "q"]], "a:int,c:str"),
        (X + "y = CREATE [[3, 'q']] SCHEMA a:int,c:str s = SUB x, y USING merge(k='o') SELECT * FROM s[j] WHERE a > 0", [[3, 4, "q"]], "a:int,b:int,c:str"),
        ("CREATE USING make(n=7) SCHEMA a:int", [[7]], "a:int"),
        (X + "CONNECT spark SELECT a FROM x WHERE a = 3", [[3]], "a:int"),
        (X + "OUTPUT x, x USING assert_eq PRINT 2 ROWS FROM x ROWCOUNT TITLE 't'", [[1, 2], [3, 4], [1, None]], "a:int,b:int"),
        (X + "-- a comment; SELECT\nSELECT a /* more */ FROM x WHERE a = {{three}}", [[3]], "a:int"),
        (X + "SELECT a, '{x}' AS s FROM x WHERE a = 3", [[3, "{x}"]], "a:int,s:str"),
        (X + "SELECT extract(YEAR FROM DATE '2020-01-02') AS y, a FROM x WHERE a = 3", [[2020, 3]], "y:int,a:int"),
        (X + "SELECT a FROM x UNION TAKE 1 ROW FROM (SELECT b AS a FROM x) PRESORT a DESC", [[1], [3], [4]], "a:int"),
        (X + "y = SELECT a FROM x WHERE a = 3 PERSIST BROADCAST SELECT y.a FROM x INNER JOIN y ON x.a = y.a", [[3]], "a:int"),
        ("SELECT * FROM outer_frame WHERE a = 5", [[5]], "a:int"),
    ],
)
def test_statements(spark, text, rows, schema):
    outer_frame = pd.DataFrame({"a": [5, 6]}).astype("int32")
    three = 3
    out = api.xsql(text, spark=spark, scope={**globals(), **locals()})
    assert same(out, rows, schema, throw=True)


def test_files(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    out = api.xsql(X + f"SAVE x OVERWRITE SINGLE csv '{path}'(header=True) LOAD csv '{path}'(header=True) COLUMNS a:int,b:int", spark=spark)
    assert same(out, [[1, 2], [3, 4], [1, None]], "a:int,b:int", throw=True)
    out = api.xsql(X + f"SAVE AND USE x PREPARTITION BY a OVERWRITE parquet '{tmp_path}/p' SELECT count(*) AS n", spark=spark)
    assert same(out, [[3]], "n:long")
    assert api.xsql(f"LOAD parquet '{tmp_path}/p' COLUMNS a", spark=spark).count() == 3


def test_yields(spark, tmp_path):
    laid = api.xsql_flow(X + "YIELD DATAFRAME y = SELECT a FROM x YIELD LOCAL DATAFRAME AS z SELECT b FROM x DETERMINISTIC CHECKPOINT 'ns' YIELD FILE AS p")
    result = laid.run(spark, checkpoint_path=str(tmp_path))
    assert result["x"].count() == 3 and len(result["z"]) == 3 and spark.read.parquet(result["p"]).columns == ["b"]
    assert laid.spec_uuid() == api.xsql_flow(X + "YIELD DATAFRAME y = SELECT a FROM x YIELD LOCAL DATAFRAME AS z SELECT b FROM x YIELD FILE AS p").spec_uuid()


def test_callback(spark):
    seen = []
    say = seen.append

    def tell(rows: list[list[Any]], f: Callable) -> None:
        f(len(rows))

    api.xsql(X + "OUTTRANSFORM PREPARTITION BY a USING tell CALLBACK say", spark=spark)
    assert sorted(seen) == [1, 2]


@pytest.mark.parametrize("text", ["nonsense", "x = PRINT", "SELECT * FROM", "TRANSFORM USING", "CREATE [[1]]", "TAKE x ROWS", X + "TRANSFORM absent USING add", "CONNECT other SELECT 1", "SELECT {{absent}}"])
def test_mistakes(spark, text):
    with pytest.raises((CompileError, Exception)):
        api.xsql(text, spark=spark).collect()
    if text in ("nonsense", "TAKE x ROWS"):
        with pytest.raises(SqlSyntaxError):
            api.xsql_flow(text)


def test_raw_sql(spark):
    a, b = frame(spark, [[1, 2]], "a:int,b:int"), frame(spark, [[1, 5]], "a:int,c:int")
    assert same(api.raw_sql("SELECT x.a, c FROM", a, "AS x JOIN", b, "AS y ON x.a = y.a"), [[1, 5]], "a:int,c:int", throw=True)


def test_a_script_s_frame_outlives_its_checkpoints(spark, tmp_path):
    out = api.xsql(X + "y = SELECT a FROM x WHERE a = 1 CHECKPOINT SELECT count(*) AS n FROM y", spark=spark, conf={"checkpoint_path": str(tmp_path), "auto_persist": True})
    gc.collect()
    assert out.collect()[0].n == 2


def test_notebook_magic(spark):
    class Shell:
        def __init__(self):
            self.user_ns = {"outer_frame": pd.DataFrame({"a": [5, 6], "s": ["<b>", "x"]})}

        def register_magic_function(self, fn, kind, name):
            assert (kind, name) == ("cell", "xsql")
            self.magic = fn

    shell = Shell()
    api.load_ipython_extension(shell)
    shown = shell.magic("kept", "SELECT a, s FROM outer_frame WHERE a = 5")
    assert "&lt;b&gt;" in shown._repr_html_() and shell.user_ns["kept"].collect()[0].a == 5


def test_html_and_plain_values(spark):
    df = spark.createDataFrame([(1, (2, float("nan")), {"k": 1}, bytearray(b"x"), float("nan"))], "a int, b struct<x:int,y:double>, c map<string,int>, d binary, e double")
    assert api.as_array(df, type_safe=True) == [[1, {"x": 2, "y": None}, {"k": 1}, b"x", None]] == list(api.as_array_iterable(df, type_safe=True))
    assert "<h3>a &amp; b</h3>" in api.to_html(df, 1, True, "a & b") and "1 rows" in api.to_html(df, 1, True)
