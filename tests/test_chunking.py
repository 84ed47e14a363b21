from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.operators import chunking
from orrery.shipping import ship


def windows(spark, rows, **more):
    df = spark.createDataFrame(rows, "id bigint, text string, other string")
    return [tuple(r) for r in chunking.windows(df, **more).orderBy("id", "chunk_index").collect()]


def test_windows_golden(spark):
    text = "a" * 8 + "\n" + "b" * 14
    got = windows(spark, [(1, text, None)], size=12)
    assert [(g[4], g[2], g[3]) for g in got] == [("a" * 8, 1, 1), ("b" * 12, 2, 2), ("b" * 3, 2, 2)]


def test_windows_edges(spark):
    got = windows(spark, [(1, "", None), (2, None, None), (3, "   ", None), (4, "a\nb\n", None), (5, " " * 4000, None), (6, "x" * 100_000, None)])
    by = {}
    for g in got:
        by.setdefault(g[0], []).append(g)
    assert set(by) == {3, 4, 6}  # empty ones and long blank ones have no window
    assert by[4][0][2:4] == (1, 2)
    assert len(by[6]) == 28 and [g[1] for g in by[6]] == list(range(28))


def loop(text, size):
    """The windows by a plain loop."""
    step, out, start, n = max(size - size // 6, 1), [], 0, len(text)
    if n == 0:
        return []
    if n <= size:
        return [text]
    while start < n and len(out) < 28:
        w = text[start : start + size]
        cut = w
        if start + size < n and "\n" in w:
            pos = w.rfind("\n")
            if len(w[:pos].encode()) > size // 2:
                cut = w[:pos]
        if cut.strip():
            out.append(cut)
        if start + size >= n:
            break
        start += step
    return out


def test_windows_are_the_loop(spark):
    import random

    random.seed(3)
    texts = ["".join(random.choice("ab\n é字") for _ in range(random.randint(0, 900))) for _ in range(60)]
    got = {}
    for g in windows(spark, [(i, t, "") for i, t in enumerate(texts)], size=30):
        got.setdefault(g[0], []).append(g[4])
    for i, t in enumerate(texts):
        assert got.get(i, []) == loop(t, 30), i


def test_pack_lines_golden():
    assert chunking.pack_lines("ab\n\ncdefgh\nijklmnopqrst", 10, 5) == [("ab\n\ncdefgh", 5, 7), ("ijklmnopqrst", 8, 8)]
    assert chunking.pack_lines("", 10) == [] and chunking.pack_lines("\n\n", 10) == []
    assert chunking.pack_lines("a\r\nb", 10) == [("a\nb", 1, 2)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(4, 40))
def test_pack_lines_keeps_every_word(text, limit):
    packs = chunking.pack_lines(text, limit)
    assert "".join(t for t, _, _ in packs).split() == text.replace("\n", "").split() or "".join("".join(t.split()) for t, _, _ in packs) == "".join(text.split())
    assert all(len(t) <= limit or "\n" not in t for t, _, _ in packs)
    assert all(a <= b for _, a, b in packs)


def test_line_packs(spark):
    ship(spark)
    df = spark.createDataFrame([(1, "ab\n\ncdefgh\nijklmnopqrst", 5), (2, None, 1), (3, "", None)], "id bigint, text string, line_start int")
    assert [tuple(r) for r in chunking.line_packs(df, 10).orderBy("chunk_index").collect()] == [(1, 0, 5, 7, "ab\n\ncdefgh"), (1, 1, 8, 8, "ijklmnopqrst")]
