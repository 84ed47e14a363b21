import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import blobs, text


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_language(spark):
    paths = ["A.PY", "x.h", "x.hpp", ".py", "README", "a.b/c", "d/e.test.tsx", "q.JSX", None]
    assert one(spark, [(p,) for p in paths], "p string", text.language_of_path(F.col("p"))) == ["Python", "C", "Cpp", "", "", "", "Tsx", "JavaScript", ""]


def test_normalize_path(spark):
    paths = ["src/a/../b/./c", "../../x/y", "/abs/z", "", "a//b/", "a/../.."]
    assert one(spark, [(p,) for p in paths], "p string", text.normalize_path(F.col("p"))) == ["src/b/c", "x/y", "abs/z", "", "a/b", ""]


def test_normalize_path_twice_is_once(spark):
    paths = ["a/./b/../c", "../x", "a/b/../../../c/./d"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(text.normalize_path(F.col("p")).alias("n"))
    assert all(a == b for a, b in df.select("n", text.normalize_path(F.col("n"))).collect())


def test_signature(spark):
    texts = ["def f(x: int):\n    return {}", "fn a() -> B { c }", "plain line\nmore", "\v\t x: 1", "", None]
    assert one(spark, [(t,) for t in texts], "t string", text.signature(F.col("t"))) == ["def f(x: int):\n    return", "fn a() -> B", "plain line", "x:", "", None]


def test_context_header(spark):
    rows = [("Method", "m", "impl A", "p"), ("TextWindow", "x", "", "p"), ("ImportBlock", "", None, "p"), ("Function", "", "", "p"), ("TypeHeader", "T", "", "p"), (None, "x", "", "p")]
    got = one(spark, rows, "k string, s string, c string, p string", text.context_header(F.col("k"), F.col("s"), F.col("c"), F.col("p")))
    assert got == ["// File: p\n// Context: impl A\n// Method: m", "// File: p", "// File: p\n// Imports", "// File: p", "// File: p\n// Type: T", "// File: p"]


def test_line_of(spark):
    rows = [("a\nb\nc", 0), ("a\nb\nc", 2), ("a\nb\nc", 99), ("", 5)]
    assert one(spark, rows, "t string, n int", text.line_of(F.col("t"), F.col("n"))) == [1, 2, 3, 1]


def test_query_class(spark):
    asked = {"src/auth": "PathQuery", "*.rs": "PathQuery", "fn validate": "CodePattern", "class Auth": "CodePattern", "how does it work": "NaturalLanguage", "snake_case": "Symbol", "camelCase": "Symbol", "two words": "NaturalLanguage", "": "NaturalLanguage", "a.b::c": "Symbol"}
    assert one(spark, [(q,) for q in asked], "q string", text.query_class(F.col("q"))) == list(asked.values())
    assert one(spark, [(None,)], "q string", text.query_class(F.col("q"))) == ["NaturalLanguage"]


def test_tokens(spark):
    assert one(spark, [("Grüße foo_1-B",), (None,)], "t string", text.tokens(F.col("t"))) == [["grüße", "foo", "1", "b"], []]


def test_blobs(spark):
    raw = np.array([1.5, -2.0], "<f4").tobytes()
    got = spark.createDataFrame([(bytearray(raw),), (bytearray(raw + b"x"),), (bytearray(b""),), (None,)], "b binary").select(blobs.decode("b").alias("v"))
    assert [r[0] for r in got.collect()] == [[1.5, -2.0], [1.5, -2.0], [], None]
    back = got.select(blobs.encode("v").alias("b")).collect()
    assert [bytes(r[0]) if r[0] is not None else None for r in back] == [raw, raw, b"", None]


def test_embedding_input(spark):
    assert one(spark, [("h", "t")], "h string, t string", text.embedding_input(F.col("h"), F.col("t"))) == ["h\nt"]


def test_similarity(spark):
    assert one(spark, [(0.0,), (3.0,)], "d double", text.similarity(F.col("d"))) == pytest.approx([1.0, 0.25])
