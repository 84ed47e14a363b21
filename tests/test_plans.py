"""What the plans of the operators look like, and what the store writes."""

import re

import pytest
from pyspark.sql import functions as F

from orrery.operators import chunking, code, lexical, vectors
from orrery.plans import search
from orrery.shipping import ship
from orrery.sources.store import Store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_shuffle_nothing(spark):
    d = spark.createDataFrame([(1, "a\n" * 3000)], "id bigint, text string")
    assert "Exchange" not in plan(chunking.windows(d)) and chunking.windows(d).count() > 1


def test_few_queries_shuffle_no_vectors(spark):
    ship(spark)
    v = spark.range(100).select(F.col("id").alias("item_id"), F.array(*[(F.rand(i) * 2 - 1).cast("float") for i in range(4)]).alias("vector"))
    text = plan(vectors.nearest(v, v.limit(3).select(F.col("item_id").alias("query_id"), "vector"), 2))
    assert text.count("MapInPandas") == 1 and "CoGroup" not in text
    assert text.index("Exchange") < text.index("MapInPandas"), "only hits are shuffled"


def test_both_ways_of_nearest_agree(spark):
    ship(spark)
    v = spark.range(300).select(F.col("id").alias("item_id"), F.array(*[((F.xxhash64("id", F.lit(i)) % 5) / 5).cast("float") for i in range(3)]).alias("vector"))
    q = v.where("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), "vector")
    rows = lambda: sorted(map(tuple, vectors.nearest(v, q, 4, block=50, rounded=6).collect()))
    few, old = rows(), vectors.FEW_QUERIES
    try:
        vectors.FEW_QUERIES = 0
        assert rows() == few and len(few) == 120
    finally:
        vectors.FEW_QUERIES = old


def test_vectors_move_once_for_many_queries(spark, monkeypatch):
    """5,000 queries, above the few that are sent to every task, are one block, and the rows are the same."""
    ship(spark)
    v = spark.range(5000).select(F.col("id").alias("item_id"), F.array(*[((F.xxhash64("id", F.lit(i)) % 97) / 97).cast("float") for i in range(3)]).alias("vector"))
    q = v.select(F.col("item_id").alias("query_id"), "vector")
    near = vectors.nearest(v, q, 2, rounded=6)
    assert re.search(r"pmod\(xxhash64\(id#\d+L, 42\), 1\) AS qb", plan(near))
    rows = sorted(map(tuple, near.collect()))
    monkeypatch.setattr(vectors, "FEW_QUERIES", 5000)
    assert rows == sorted(map(tuple, vectors.nearest(v, q, 2, rounded=6).collect())) and len(rows) == 10_000


def test_one_parse_gives_chunks_and_windows(spark):
    ship(spark)
    f = spark.createDataFrame([(1, "a.py", "def f():\n    return 1\n"), (2, "b.txt", "text"), (3, "c.py", None)], "id bigint, path string, text string")
    c = code.chunks(code.analyze(f))
    assert plan(c).count("MapInPandas") == 1
    assert sorted((r.id, r.kind, r.line_start, r.line_end) for r in c.collect()) == [(1, "Function", 1, 2), (2, "TextWindow", 1, 1)]
    assert code.errors(code.analyze(f)).count() == 0


def test_bm25_reads_texts_once(spark, tmp_path):
    d = spark.createDataFrame([(i, f"w{i % 7} x") for i in range(50)], "id bigint, text string")
    d.write.parquet(str(tmp_path / "docs"))
    q = spark.createDataFrame([(1, "w3 x")], "query_id bigint, text string")
    text = plan(lexical.bm25(spark.read.parquet(str(tmp_path / "docs")), q))
    assert "/docs" not in text and re.search("WindowGroupLimit", text)


def test_store_rewrites_touched_buckets(spark, tmp_path):
    s = Store(str(tmp_path / "s"), 1, 8)
    rows = lambda ids, x: spark.createDataFrame([(i, [float(x)]) for i in ids], "chunk_id bigint, vector array<float>")
    s.write(spark, rows(range(100), 0), "m")
    s.upsert(spark, rows([5], 9))
    at = s._read_pointer(spark)
    assert sorted(at["at"].values()) == [1] * 7 + [2] and at["model"] == "m"
    assert {r.chunk_id: r.vector[0] for r in s.open(spark).collect()} == {i: 9.0 if i == 5 else 0.0 for i in range(100)}
    with pytest.raises(Exception, match="another length"):
        s.upsert(spark, spark.createDataFrame([(7, [1.0, 2.0])], "chunk_id bigint, vector array<float>"))
    assert s.count(spark) == 100 and s._read_pointer(spark)["version"] == 2
    s.delete(spark, rows(range(0, 100, 2), 0))
    assert s.count(spark) == 50
    gone = s.vacuum(spark)
    assert 1 in gone and s.count(spark) == 50 and s._pointers(spark) == [3]
    assert s.upsert(spark, rows([], 0)) is None


def test_expansion_and_related(spark):
    hits = spark.createDataFrame([(1, 10, "a", 0.5), (1, 11, "b", 0.1)], "query_id bigint, id bigint, project string, score double")
    near = spark.createDataFrame([(1, 12, "a", 0.5), (1, 13, "c", 1.0), (1, 14, "z", 1.0), (1, 10, "a", 1.0)], "query_id bigint, id bigint, project string, similarity double")
    edges = spark.createDataFrame([("a", "c", 0.5)], "src string, dst string, strength double")
    got = {r.id: r.score for r in search.expand(hits, near, edges).collect()}
    assert got == {10: 0.5, 11: 0.1, 12: pytest.approx(0.5 * (0.76 + 0.12 * 0.5)), 13: pytest.approx(0.5 * (0.2 + 0.7 * 0.5) * 0.6)}
    chunks = spark.createDataFrame([(i, 1, i) for i in range(8)], "chunk_id bigint, file_id bigint, chunk_index int")
    packed = spark.createDataFrame([(1, 3, 1, 3), (1, 4, 1, 4)], "query_id bigint, id bigint, file_id bigint, chunk_index int")
    got = sorted((r.seed, r["rank"], r.id) for r in search.related_chunks(packed, chunks).collect())
    assert got == [(3, 1, 2), (3, 2, 1), (3, 3, 5), (4, 1, 5), (4, 2, 2), (4, 3, 6)]


def test_hypothetical_texts_are_for_natural_language_only(spark):
    ship(spark)
    q = spark.createDataFrame([(1, "how does the cache work"), (2, "loadFile"), (3, "src/a.py")], "query_id bigint, text string")
    got = search.hypothetical(q, lambda ts: [t.upper() for t in ts], vectors.hashed_words(8)).collect()
    assert [r.query_id for r in got] == [1] and len(got[0].vector) == 8


def test_grades_come_in_batches(spark):
    from orrery.operators import fusion

    ship(spark)

    def grade(pairs):
        assert len(pairs) <= 8
        return [float(len(pairs))] * len(pairs)

    c = spark.createDataFrame([(1, i, 1.0, "a", "a") for i in range(20)], "query_id bigint, id bigint, score double, query string, text string").coalesce(1)
    assert sorted(r.score for r in fusion.rerank(c, grade).collect()) == [pytest.approx(0.7 * 0.4 + 0.3)] * 4 + [pytest.approx(0.7 * 0.8 + 0.3)] * 16


def test_texts_are_moved_for_those_who_ask(spark, small):
    """The latest row is the same whichever columns are asked for, and the text is not read where it is not."""
    c = spark.read.parquet(f"{small}/semantic_chunks.parquet")
    light = search.latest_chunks(c, "project", "symbol_name")
    assert "text:string" not in plan(light) and "text:string" in plan(search.latest_chunks(c))
    assert light.columns == ["chunk_id", "project", "symbol_name"]
    assert sorted(map(repr, light.collect())) == sorted(map(repr, search.latest_chunks(c).select(light.columns).collect()))


def test_graded_pool_is_not_shuffled(spark):
    from orrery.operators import fusion

    c = spark.createDataFrame([(1, i, 1.0, "a", "a") for i in range(20)], "query_id bigint, id bigint, score double, query string, text string")
    assert "Exchange" not in plan(fusion.graded(c)) and "Exchange" in plan(fusion.rerank(c))


def test_dedup_moves_texts_by_query_only(spark):
    from orrery.operators import packing

    h = spark.createDataFrame([(1, i, 1.0 - i / 10, t) for i, t in enumerate(["a b c d", "a b c e", "x y"])], "query_id bigint, id bigint, score double, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = packing.dedup(h)
        assert not re.search(r"hashpartitioning\(query_id#\w+, id#", plan(d)) and sorted(r.id for r in d.collect()) == [0, 2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["pack_diversity", "pack_order", "tiered_search", "rrf_fusion"])
def test_what_needs_no_text_reads_it_for_the_index_only(spark, small, name):
    from orrery.plans import catalogue

    assert "text:string" not in plan(catalogue.QUERIES[name](ship(spark), small))
