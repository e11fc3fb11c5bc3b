import pyarrow as pa
import pytest
from pyspark.sql import types as T

from lamina.errors import SchemaError
from lamina.schema import format_schema, parse_schema, transform_schema


@pytest.mark.parametrize(
    "text",
    ["a:int", "a:int,b:str", "a:[int]", "a:{x:int,y:[str]}", "a:<str,double>", "a:decimal(10,2)", "`a b`:long,` `:str", "a:datetime,b:date,c:bytes,d:bool", "a:[{a:str,b:[int]}]"],
)
def test_round_trip(text):
    assert format_schema(parse_schema(text)) == text


def test_aliases_and_sources():
    assert format_schema(parse_schema("a:int64,b:string,c:float64,d:int8")) == "a:long,b:str,c:double,d:byte"
    assert format_schema(parse_schema({"a": int, "b": float})) == "a:long,b:double"
    assert format_schema(parse_schema(pa.schema([("a", pa.int32()), ("b", pa.list_(pa.string()))]))) == "a:int,b:[str]"
    assert isinstance(parse_schema("a:uint64").fields[0].dataType, T.DecimalType)


@pytest.mark.parametrize("text", ["", "a", "a:", "a:nope", "a:int,a:int", "a:[int", "a:int b:int", "a:int,b"])
def test_mistakes(text):
    with pytest.raises(SchemaError):
        parse_schema(text)


@pytest.mark.parametrize(
    "change,expected",
    [
        ("*", "k:int,a:str"), ("*,x:long", "k:int,a:str,x:long"), ("*~k+AA:str,bb:int", "a:str,AA:str,bb:int"), ("*-k", "a:str"), ("*~zz", "k:int,a:str"),
        ("*+a:int", "k:int,a:int"), (["*", "x:int"], "k:int,a:str,x:int"), ("x:int", "x:int"), (lambda s, n=1: f"*,c{n}:int", "k:int,a:str,c1:int"),
    ],
)
def test_changes(change, expected):
    assert format_schema(transform_schema(parse_schema("k:int,a:str"), change)) == expected


@pytest.mark.parametrize("change", ["*-zz", "*,k:int", "*-k,a", "*,x"])
def test_wrong_changes(change):
    with pytest.raises(SchemaError):
        transform_schema(parse_schema("k:int,a:str"), change)
