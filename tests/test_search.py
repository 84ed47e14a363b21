import math

import pytest
from pyspark.sql import functions as F

from orrery.operators import fusion, graph, imports, lexical, packing
from orrery.shipping import ship


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "A")], "id bigint, text string")
    q = spark.createDataFrame([(9, "a a"), (8, ""), (7, "zzz")], "query_id bigint, text string")
    got = {r.id: r.score for r in lexical.bm25(docs, q).collect()}
    avg, n, df = 6 / 4, 4, 2
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)), 6)
    assert got == {1: part(2, 3), 4: part(1, 1)}


def test_bm25_with_and_without_pruning(spark):
    """Common words beside rare ones: the pruned way gives the same rows as the plain one."""
    import random

    random.seed(8)
    docs = spark.createDataFrame([(i, " ".join(random.choices(["the", "of", "and"], k=random.randint(5, 30)) + random.choices([f"w{j}" for j in range(60)], k=3))) for i in range(400)], "id bigint, text string")
    q = spark.createDataFrame([(i, f"the of w{i} w{i + 1}") for i in range(40)] + [(99, "the")], "query_id bigint, text string")
    old = lexical.PRUNE_FROM
    try:
        lexical.PRUNE_FROM = 0
        pruned = rows(lexical.bm25(docs, q, 3))
        lexical.PRUNE_FROM = 1e9
        plain = rows(lexical.bm25(docs, q, 3))
    finally:
        lexical.PRUNE_FROM = old
    assert pruned == plain and len(plain) == 41 * 3


def test_bm25_sums_inside_blocks(spark, monkeypatch):
    """Pairs of query and document are not shuffled, and blocks, equal queries and ties give the rows of a loop."""
    import random

    random.seed(3)
    words = [random.choices(["a", "b", "c", "d"], [8, 4, 2, 1], k=random.randint(0, 9)) for _ in range(300)]
    asked = {q: ["a", "b", "a b", "b a", "c d a", "zzz", ""][q % 7] for q in range(21)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "id bigint, text string")
    avg = sum(map(len, words)) / 300
    want = []
    for q, text in asked.items():
        sums = {}
        for t in set(text.split()):
            df = sum(t in w for w in words)
            idf = math.log(1 + (300 - df + 0.5) / (df + 0.5))
            for i, w in enumerate(words):
                if t in w:
                    sums[i] = sums.get(i, 0) + round(idf * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg)) * 1e6)
        want += [(q, i, s / 1e6, r) for r, (i, s) in enumerate(sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:12])]
    for block, terms in ((250_000, 500_000), (90, 2)):
        monkeypatch.setattr(lexical, "BLOCK", block)
        monkeypatch.setattr(lexical, "TERMS", terms)
        found = lexical.bm25(docs, spark.createDataFrame(list(asked.items()), "query_id bigint, text string"), 12)
        assert "CoGroup" in found._jdf.queryExecution().executedPlan().toString()
        assert rows(found) == sorted(want)


def test_queries_of_the_same_words_are_packed_once(spark):
    q = spark.createDataFrame([(4, "load file"), (2, "File load load"), (7, "x"), (9, "--")], "query_id bigint, text string")
    one, of = lexical.representatives(q)
    assert rows(one) == [(2, "File load load"), (7, "x")] and rows(of) == [(2, 2), (4, 2), (7, 7)]
    assert rows(lexical.for_all(one.select("query_id", "text"), of)) == [(2, "File load load"), (4, "File load load"), (7, "x")]


@pytest.mark.parametrize("name", ["pack_context", "pack_budget", "pack_documents", "pack_dedup", "pack_order", "tiered_search", "hyde_blend", "pack_diversity", "rerank_blend"])
def test_packing_starts_from_one_query_of_the_same_words(spark, small, monkeypatch, name):
    from orrery.plans import catalogue

    asked = []
    bm25 = lexical.bm25
    monkeypatch.setattr(catalogue.lexical, "bm25", lambda docs, queries, *more: asked.append(queries) or bm25(docs, queries, *more))
    names = catalogue._name_queries(spark, small)
    double = names.unionByName(names.selectExpr("query_id + 1000000 as query_id", "text"))
    monkeypatch.setattr(catalogue, "_name_queries", lambda *_: double)
    got = rows(catalogue.QUERIES[name](ship(spark), small))
    assert asked[0].count() <= names.count()
    twin = sorted((r[0] - 1000000, *r[1:]) for r in got if r[0] >= 1000000)
    assert twin == [r for r in got if r[0] < 1000000] and twin


def test_token_stats(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "id bigint, text string")
    assert rows(lexical.token_stats(docs)) == [("a", 2, 1), ("b", 2, 2)]


def test_path_and_prefix(spark):
    p = spark.createDataFrame([(1, "src/auth/login.rs"), (2, "src/x_y.py"), (3, None)], "id bigint, path string")
    q = spark.createDataFrame([(1, "auth src"), (2, "y")], "query_id bigint, text string")
    assert rows(lexical.path_matches(p, q).select("query_id", "id", "score")) == [(1, 1, 1.0), (1, 2, 0.5), (2, 2, 1.0)]
    s = spark.createDataFrame([(1, "loadFile"), (2, "load"), (3, ""), (4, None), (5, "l")], "id bigint, name string")
    q = spark.createDataFrame([(1, "Load"), (2, "l"), (3, " ")], "query_id bigint, text string")
    got = rows(lexical.symbol_prefix(s, q).select("query_id", "rank", "id"))
    assert got == [(1, 0, 2), (1, 1, 1), (2, 0, 5), (2, 1, 2), (2, 2, 1)]


def test_path_words_are_counted_inside_blocks(spark):
    """Pairs of query and path are not shuffled; a repeated row counts again, as ever."""
    p = spark.createDataFrame([(i, f"src/{'ab'[i % 2]}/x.py") for i in range(9)] + [(8, "src/a/x.py")], "id bigint, path string")
    q = spark.createDataFrame([(1, "a src"), (2, "src a"), (3, "zzz")], "query_id bigint, text string")
    m = lexical.path_matches(p, q, 3)
    assert "CoGroup" in m._jdf.queryExecution().executedPlan().toString()
    want = [(8, 2.0, 0), (0, 1.0, 1), (2, 1.0, 2)]
    assert rows(m) == [(k, *r) for k in (1, 2) for r in sorted(want)]


def test_fusion(spark):
    hits = spark.createDataFrame([(1, "vector", 5, 0), (1, "lexical", 5, 1), (1, "lexical", 6, 0), (2, "path", 7, 0)], "query_id bigint, source string, id bigint, rank int")
    k = spark.createDataFrame([(1, "Symbol"), (2, "PathQuery")], "query_id bigint, query_class string")
    got = {(r.query_id, r.id): r.score for r in fusion.fuse(hits, k).collect()}
    w = fusion.WEIGHTS
    assert got[1, 5] == pytest.approx(w["Symbol"]["vector"] / 61 + w["Symbol"]["lexical"] / 62, abs=1e-8)
    assert got[2, 7] == pytest.approx(w["PathQuery"]["path"] / 61, abs=1e-8)


def test_rerank_hyde_tier(spark):
    ship(spark)
    c = spark.createDataFrame([(1, i, 1.0 / i, "a b", "a" if i % 2 else "a b") for i in range(1, 80)], "query_id bigint, id bigint, score double, query string, text string")
    got = {r.id: r.score for r in fusion.rerank(c).collect()}
    assert len(got) == 60 and got[1] == pytest.approx(0.7 * 0.5 + 0.3) and got[2] == pytest.approx(0.7 + 0.15)
    a = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5)], "query_id bigint, id bigint, score double")
    b = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0)], "query_id bigint, id bigint, score double")
    assert rows(fusion.hyde_blend(a, b)) == [(1, 1, 0.7), (1, 2, 0.65), (1, 3, 0.3)]
    h = spark.createDataFrame([(1, i, f"p{i}", float(i)) for i in range(6)], "query_id bigint, id bigint, project string, score double")
    p = h.select("project")
    assert fusion.tier(h, p, 200, 2).count() == 6
    assert rows(fusion.tier(h, p, 1, 2).select("id")) == [(4,), (5,)]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.5), ("c", "d", 1.0)], "src string, dst string, strength double")
    s = spark.createDataFrame([("a",)], "project string")
    assert {r.project: r.weight for r in graph.expand(s, e).collect()} == {"a": 1.0, "b": pytest.approx(0.54), "c": pytest.approx(0.54 * 0.55 * 0.6)}
    f = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", None), (None, "x")], "project string, feature string")
    assert rows(graph.project_edges(f)) == [("a", "b", 0.5), ("b", "a", 0.5)]
    log = spark.createDataFrame([("a", "b", 1, "Suppress"), ("a", "b", 2, "Restore"), ("b", "c", 3, "Suppress")], "src string, dst string, ts int, decision string")
    assert rows(graph.without_suppressed(e, log).select("src", "dst")) == [("a", "b"), ("c", "d")]
    r = spark.createDataFrame([(1, i, float(i % 3)) for i in range(1, 9)], "src bigint, dst bigint, weight double")
    assert rows(graph.related(spark.createDataFrame([(1,)], "id bigint"), r).select("rank", "id")) == [(1, 2), (2, 5), (3, 8)]
    ev = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-15"), (2, "2024-02-01"), (None, "2024-01-01")], "u bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(graph.frecency(ev, "u", "2024-01-15 00:00:00")) == [(1, round(1 + math.exp(-1), 6))]


def test_packing(spark):
    text = ["a b c d", "a b c e", "x y z", "a b c d f", "q r s"]
    h = spark.createDataFrame([(1, i, 1.0 - i / 10, t, i // 2, "p", i, "extra") for i, t in enumerate(text)], "query_id bigint, id bigint, score double, text string, file_id bigint, project string, chunk_index int, more string")
    kept = []
    for i, t in enumerate(text):  # the greedy pass as a loop
        s = set(t.split())
        if all(len(s & set(text[j].split())) <= 0.5 * len(s | set(text[j].split())) for j in kept):
            kept.append(i)
    assert [r[0] for r in rows(packing.dedup(h).select("id"))] == kept
    many = spark.createDataFrame([(1, i, 1.0 - i / 100, "t", i // 5, f"p{i // 15}") for i in range(45)], "query_id bigint, id bigint, score double, text string, file_id bigint, project string")
    d = packing.diverse(many)
    assert max(r[0] for r in d.groupBy("file_id").count().select("count").collect()) == 3 and max(r[0] for r in d.groupBy("project").count().select("count").collect()) == 8
    assert [r[0] for r in rows(packing.within_budget(h, 15).select("id"))] == [0, 1]
    assert [r.id for r in packing.coherent(h).orderBy("position").collect()] == [0, 1, 2, 3, 4]
    assert packing.pack(h, 100).count() == len(kept) and packing.pack(h.limit(0)).count() == 0


def test_whole_documents(spark):
    p = spark.createDataFrame([(1, 1, 4, 4, "c"), (1, 0, 1, 2, "a\nb"), (1, 0, 1, 2, "a\nb"), (2, 0, None, None, None), (None, 0, 1, 1, "z")], "file_id bigint, chunk_index int, line_start int, line_end int, text string")
    assert rows(packing.documents(p)) == [(1, "a\nb\n\nc"), (2, "")]


def resolve(spark, lang_file, spec, files):
    i = spark.createDataFrame([(1, "p", lang_file, spec)], "import_id bigint, project string, source_file string, raw_specifier string")
    f = spark.createDataFrame([("p", x, k) for k, x in enumerate(files)] + [("other", "src/auth.rs", 0)], "project string, path string, ordinal int")
    return imports.resolve(i, f).first().resolved


@pytest.mark.parametrize(
    "source,spec,files,want",
    [
        ("pkg/auth.py", "pkg.util", ["pkg/auth.py", "pkg/util.py"], "pkg/util.py"),
        ("pkg/auth.py", "os", ["pkg/auth.py"], ""),
        ("a.py", "..m", ["x/m/__init__.py"], "m/__init__.py"),  # the candidate is returned, not the file
        ("a.py", "...", ["a.py"], ""),
        ("src/lib.rs", "crate::auth", ["src/lib.rs", "src/auth.rs"], "src/auth.rs"),
        ("src/lib.rs", "std::fmt", ["src/auth.rs"], ""),
        ("src/lib.rs", "crate::auth", ["x/src/auth.rs"], ""),  # exact only
        ("web/app.ts", "./r", ["web/r.ts"], "web/r.ts"),
        ("web/app.ts", "x", ["web/x.ts"], ""),
        ("web/app.ts", "../q", ["q/index.js", "q.mjs"], "q.mjs"),
        ("a.go", "fmt", ["a.go", "pkg/util/u.go"], ""),
        ("a.go", "x/y/util", ["a.go", "pkg/util/u.go", "util/z.go"], "pkg/util/u.go"),
        ("A.java", "com.x.Y", ["b/com/x/Y.java", "com/x/Y.java"], "b/com/x/Y.java"),
        ("A.java", "Y", ["b/XY.java"], "b/XY.java"),  # no boundary before the name
        ("A.java", "com.x.*", ["com/x/Y.java"], ""),
        ("src/x.c", "a/b.h", ["src/a/b.h"], "src/a/b.h"),
        ("src/x.c", "a/b.h", ["inc/a/b.h"], "a/b.h"),
        ("notes.md", "x", ["x"], ""),
    ],
)
def test_import_resolution(spark, source, spec, files, want):
    assert resolve(spark, source, spec, files) == want
