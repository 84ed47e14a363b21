from datetime import datetime

import pytest

from orrery.llm import p4_docs
from orrery.shipping import ship


@pytest.mark.parametrize(
    "name,signature,doc,want",
    [
        ("drainCache", "drainCache(a)", "/** Blocks until every writer has finished. */", True),
        ("drain_cache", "def drain_cache(self):", '"""Drains the cache."""', False),
        ("drainCache", "drainCache()", "// drainCache function", False),
        ("drainCache", "drainCache()", "/**\n * This method drains a cache\n */", False),
        ("f", "f(span)", "/**\n * @param span the span\n * @return the result\n */", False),
        ("f", "f(span)", "/**\n * @param span bytes counted from zero, never negative\n */", True),
        ("f", "f()", "# TODO: document this", False),
        ("f", "f()", "/**\n * TODO: rename\n * Sizes are in bytes, offsets count from zero.\n */", True),
        ("f", "f()", "// eslint-disable-next-line no-undef", False),
        ("f", "f()", "/** Copyright the respective authors */", False),
        ("f", "f()", "// total = old_probe(mode);", False),
        ("f", "f()", "/* ---- **** ---- */", False),
        ("f", "f()", "", False),
        ("f", "f()", None, False),
        ("f", "f()", "// Wartet, bis der Puffer leer ist, und meldet dann die Anzahl.", True),
        ("f", "f()", "// siehe oben", False),
        ("f", "f()", "/** 空になるまで待ってから行数を返す */", True),
        (None, "f()", "/// Walks the tree backwards to find its root.", True),
    ],
)
def test_says(name, signature, doc, want):
    assert bool(p4_docs.says(name, signature, doc)) is want


def test_parameters():
    assert p4_docs.parameters("def f(self, a: int = (1, 2), *b)") == ["a", "b"]
    assert p4_docs.parameters("func (s *T) M(x []byte, y map[string]int) error") == ["x", "byte", "y", "int"]
    assert p4_docs.parameters("fn g(&self, k: &[u8])") == ["k"] and p4_docs.parameters(None) == [] == p4_docs.parameters("class A")


def best(functions, comments):
    """The cheapest complete assignment by trying all, over the same links."""
    import itertools

    edges = p4_docs.links(functions, comments)
    options = [list(e.items()) for e in edges.values()]
    return min((sum(c for _, c in pick) for pick in itertools.product(*options) if len({k for k, _ in pick}) == len(pick)), default=0.0), edges


def test_assignment_is_the_cheapest():
    import random

    random.seed(4)
    for _ in range(200):
        n = random.randint(1, 5)
        functions = [(f"fn{k}", random.sample(["a", "b", "c"], random.randint(0, 2))) for k in range(n)]
        comments = ["" if random.random() < 0.3 else "\n".join(f"@param {x} text" for x in random.sample(["a", "b", "c"], random.randint(0, 2))) or "words" for _ in range(n)]
        want, edges = best(functions, comments)
        old, p4_docs.IMPLAUSIBLE = p4_docs.IMPLAUSIBLE, 1e9
        try:
            got = p4_docs.assign(functions, comments)
        finally:
            p4_docs.IMPLAUSIBLE = old
        assert sum(c is not None for c in got) == len(edges)
        assert sum(edges[c][k] for k, c in enumerate(got) if c is not None) == pytest.approx(want)


def test_a_comment_goes_where_its_tags_fit():
    functions = [("load", ["path"]), ("save", ["target", "data"])]
    assert p4_docs.assign(functions, ["@param target where\n@param data what", ""]) == [None, 0]


def test_an_implausible_link_is_rejected():
    doc = "/** Waits for the writers.\n * @param colour which\n * @param width how far\n */"
    assert p4_docs.assign([("load", ["path"]), ("save", ["target"])], [doc, ""]) == [None, None]
    assert p4_docs.assign([("load", ["colour"]), ("save", ["target"])], [doc, ""]) == [0, None]
    assert p4_docs.assign([("a", []), ("b", []), ("save", ["colour", "width"])], [doc, "", ""]) == [None, None, 0]


def test_displaced_comments_go_back():
    """Comments with tags or a leading name, swapped with a neighbour's or moved to one without, are found again; orphans and far ones are dropped."""
    import random

    random.seed(9)
    names = [f"{a}{b}" for a in ("load", "save", "drop", "scan") for b in ("Rows", "Path", "Cache", "Index", "Frame")]
    functions = [(n, [f"{n[0]}{k}" + n[4:].lower() for k in range(1 + i % 2)]) for i, n in enumerate(names)]
    tagged = lambda k: "Waits for the disk.\n" + "\n".join(f"@param {p} what" for p in functions[k][1])
    led = lambda k: f"{functions[k][0]} waits for the disk."
    back = there = 0
    for _ in range(100):
        own = [random.choice((tagged, led))(k) for k in range(len(names))]
        shown, k = list(own), 0
        while k + 1 < len(names):
            if random.random() < 0.5:
                shown[k], shown[k + 1] = shown[k + 1], shown[k]
                k += 1
            elif random.random() < 0.3:
                shown[k], shown[k + 1] = "", own[k]
                k += 1
            k += 1
        got = p4_docs.assign(functions, shown)
        assert all(c is None or shown[c] == own[f] for f, c in enumerate(got))
        back, there = back + sum(c is not None for c in got), there + sum(x in shown for x in own)
    assert back >= 0.98 * there
    assert p4_docs.assign(functions[:4], ["", "", "", "Reads.\n@param other what\n@param more what"]) == [None] * 4  # nobody's
    assert p4_docs.assign(functions[:6], [tagged(5), "", "", "", "", ""]) == [None] * 6  # too far away


def test_parameters_with_qualified_types():
    assert "origin" in p4_docs.parameters("std::string f(const std::string &origin, int n)")


def test_an_untagged_comment_goes_to_the_function_it_names():
    functions = [("loadPath", ["path"]), ("saveRows", ["rows"])]
    assert p4_docs.assign(functions, ["// saveRows blocks until the disk has answered.", ""]) == [None, 0]
    assert p4_docs.assign(functions, ["// saveRows blocks until the disk has answered.", "// loadPath follows links."]) == [1, 0]
    assert p4_docs.assign(functions, ["// Undoes what saveRows did before.", ""]) == [0, None]


def test_rows(spark):
    ship(spark)
    t, u = datetime(2024, 1, 1), datetime(2024, 1, 2)
    doc = "/** Blocks until every writer has finished. */"
    rows = [
        (1, 1, "f", "Function", 1, "f(a)", doc, t, "x"), (1, 1, "f", "Function", 1, "f(a)", None, u, "x"),  # the later row has no comment
        (2, 1, "g", "METHOD", 9, "g()", doc, t, "x"), (3, 1, "h", "class", 20, "class h", doc, t, "x"), (4, 1, "k", "method", 30, "  ", doc, t, "x"), (5, 1, "l", "method", 40, None, doc, t, "x"),
        (6, None, None, "method", None, "m()", doc, None, "x"), (7, None, "n", "method", None, "n()", "", None, "x"), (None, 1, "o", "method", 1, "o()", doc, t, "x"), (8, 2, "p", None, 1, "p()", doc, t, "x"), (9, 2, "q", "function", 1, "q()", "x" * 50_000 + " y" * 50_000, t, "x"),
    ]
    df = spark.createDataFrame(rows, "symbol_id bigint, file_id bigint, name string, kind string, line_start int, signature string, doc_comment string, indexed_at timestamp, words string")
    assert {r[0] for r in p4_docs.documented(df).collect()} == {2, 6}
    assert {r.symbol_id for r in p4_docs.pairs(df).collect()} == {1, 2, 6, 7, 9}
    assert p4_docs.pairs(df.limit(0)).count() == 0
