from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import p3_split
from orrery.shipping import ship


def size(t):
    return len(t.encode("utf-8", "surrogatepass"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é字.\n{}", max_size=600), st.integers(20, 120), st.integers(0, 9))
def test_pieces(text, limit, overlap):
    parts = p3_split.split(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (a, b), (c, d) in zip(parts, parts[1:]):
        assert a < c <= b < d  # in order, no gap
        assert size(text[c:b]) <= overlap
    assert all(size(text[a:b]) <= limit for a, b in parts)


def test_natural_boundaries():
    text = "\n\n".join("line " * 12 + f"end{k}" for k in range(10))
    for a, b in p3_split.split(text, 200, 0)[:-1]:
        assert text[:b].endswith("\n\n")
    words = "word " * 100
    assert all(words[b - 1] == " " for a, b in p3_split.split(words, 60, 0)[:-1])
    assert p3_split.split("x" * 25, 10, 0) == [(0, 10), (10, 20), (20, 25)]  # a hard cut
    assert p3_split.split("字" * 10, 10, 0) == [(0, 3), (3, 6), (6, 9), (9, 10)]  # never inside a character
    assert p3_split.split("x" * 25, 10, 3)[1][0] == 7
    assert p3_split.split("", 10, 0) == [(0, 0)]


def test_rows(spark):
    ship(spark)
    t = datetime(2024, 1, 1)
    big = "def f():\n" + "    a = 1\n" * 400
    rows = [(1, big, "function", 10, t, "x", 7), (1, big, "function", 10, t, "x", 7), (2, "small", "Method", 1, t, "x", 7), (3, None, None, None, t, "x", 7), (4, "", None, 1, t, "x", 7), (5, "y" * 1501, None, None, None, "x", 7), (6, "字" * 501, "odd", 3, t, "x", 7), (7, "z" * 1500, "Method", 1, t, "x", 7), (None, big, None, 1, t, "x", 7)]
    df = spark.createDataFrame(rows, "chunk_id bigint, text string, kind string, line_start int, indexed_at timestamp, piece string, bytes int")
    got = p3_split.pieces(df).orderBy("chunk_id", "piece").collect()
    assert {r.chunk_id for r in got} == {1, 5, 6} == {r[0] for r in p3_split.oversized(df).collect()}
    one = [r for r in got if r.chunk_id == 1]
    assert one[0].kind == "Function" and one[0].line_start == 10 and one[-1].line_end == 10 + 400
    assert all(r.bytes <= 1500 and r.bytes == size(r.text) for r in got) and one[0].pieces == len(one)
    for a, b in zip(one, one[1:]):
        assert b.line_start <= a.line_end + 1 and b.char_start <= a.char_end
    assert [r.kind for r in got if r.chunk_id in (5, 6)] == [None, None, "odd", "odd"]
    assert p3_split.pieces(df.limit(0)).count() == 0
