import numpy as np
import pytest

from orrery.operators import vectors
from orrery.shipping import ship
from orrery.sources import store


def scores(spark, rows):
    df = spark.createDataFrame([(0, *r) for r in rows], "q int, id bigint, distance double")
    return {r.id: round(r.score, 6) for r in vectors.normalize_distances(df, ["q"], "id").collect()}


def test_normalize_distances(spark):
    assert scores(spark, [(1, 0.0), (2, 1.0), (3, 3.0)]) == {1: 1.0, 2: 0.333333, 3: 0.0}
    assert scores(spark, [(1, 1.0), (1, 0.0)]) == {1: 1.0}
    assert scores(spark, [(7, 4.0)]) == {7: 1.0}
    assert scores(spark, []) == {}
    assert scores(spark, [(1, None), (2, 1.0)]) == {2: 1.0}


def test_nearest_is_brute_force(spark):
    ship(spark)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[7] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0])]
    v = spark.createDataFrame(rows, "item_id bigint, vector array<float>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 20)] + [(9, x[9].tolist()), (999, None)], "query_id bigint, vector array<float>")
    got = {}
    for r in vectors.nearest(v, q, 5, block=64).orderBy("query_id", "distance", "item_id").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    for i in got:
        d = ((x.astype(float) - x[i].astype(float)) ** 2).sum(1)
        assert got[i] == [int(j) for j in np.lexsort((np.arange(300), d))[:5]]
    assert len(got) == 16 and got[9][:2] == [7, 9]


def test_nearest_clamps_k_and_takes_empty_tables(spark):
    ship(spark)
    v = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "item_id bigint, vector array<float>")
    q = spark.createDataFrame([(5, [1.0])], "query_id bigint, vector array<float>")
    assert [r.item_id for r in vectors.nearest(v, q, 0).collect()] == [1]
    assert vectors.nearest(v, q.limit(0), 3).count() == 0
    assert vectors.nearest(v.limit(0), q, 3).count() == 0
    assert len(vectors.search(v, q, 50).collect()) == 2


def test_upsert(spark):
    old = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "chunk_id bigint, vector array<float>")
    new = spark.createDataFrame([(2, [9.0], 1), (2, [8.0], 2), (3, [3.0], 1)], "chunk_id bigint, vector array<float>, n int")
    got = {r.chunk_id: r.vector for r in store.upsert(old, new, 1, "n").collect()}
    assert got == {1: [1.0], 2: [8.0], 3: [3.0]}
    again = store.upsert(store.upsert(old, new, 1, "n"), new, 1, "n")
    assert {r.chunk_id: r.vector for r in again.collect()} == got
    assert {r.chunk_id for r in store.delete(again, spark.createDataFrame([(2,), (77,)], "chunk_id bigint")).collect()} == {1, 3}


@pytest.mark.parametrize("bad", [[1.0, 2.0], None])
def test_upsert_of_a_wrong_length_fails(spark, bad):
    old = spark.createDataFrame([(1, [1.0])], "chunk_id bigint, vector array<float>")
    new = spark.createDataFrame([(2, bad)], "chunk_id bigint, vector array<float>")
    with pytest.raises(Exception, match="another length"):
        store.upsert(old, new, 1).collect()


def test_rebuild_skips_wrong_lengths(spark):
    f = lambda *x: bytearray(np.array(x, "<f4").tobytes())
    rows = spark.createDataFrame([(2, "m", 2, f(1, 2, 3)), (1, "m", 2, f(1, 2)), (3, "other", 3, f(1, 2, 3)), (4, "m", 2, None)], "chunk_id bigint, model string, dim int, vector binary")
    assert [(r.chunk_id, r.vector) for r in store.rebuild(rows, "m").collect()] == [(1, [1.0, 2.0])]
    assert store.rebuild(rows, "none").count() == 0


def test_store_versions(spark, tmp_path):
    s = store.Store(str(tmp_path / "s"), 1)
    assert s.count(spark) == 0 and s.open(spark).columns == ["chunk_id", "vector"]
    a = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "chunk_id bigint, vector array<float>")
    assert s.upsert(spark, a.limit(0)) is None
    s.write(spark, a, "model-a")
    s.upsert(spark, spark.createDataFrame([(2, [5.0])], "chunk_id bigint, vector array<float>"))
    s.delete(spark, spark.createDataFrame([(1,)], "chunk_id bigint"))
    assert [(r.chunk_id, r.vector) for r in s.open(spark).collect()] == [(2, [5.0])]
    s.check_model(spark, "model-a")
    with pytest.raises(ValueError):
        s.check_model(spark, "model-b")
    with pytest.raises(Exception):
        s.upsert(spark, spark.createDataFrame([(3, [5.0, 6.0])], "chunk_id bigint, vector array<float>"))
    assert s.count(spark) == 1  # a failed write changes nothing


def test_embed_batches_and_retries(spark):
    ship(spark)
    t = spark.createDataFrame([(i, f"text {i}" if i else None) for i in range(50)], "id bigint, text string").coalesce(1)

    def flaky(texts, calls=[0]):
        assert len(texts) <= 24
        calls[0] += 1
        if calls[0] % 2:
            raise OSError("busy")
        return [[float(len(x))] for x in texts]

    got = vectors.embed(t, flaky).collect()
    assert len(got) == 50 and {r.id: r.vector for r in got}[0] == [0.0]
    same = vectors.hashed_words(16)
    assert np.allclose(same(["a b"])[0], same(["b a"])[0]) and not np.any(same([""])[0])


def test_queries_of_few_numbers_move_no_vectors(spark, monkeypatch):
    """Too many queries for one look, few enough to be sent: slices against blocks, the same rows, and vectors are not shuffled."""
    ship(spark)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)] + [(1000, None), (1001, [1.0])], "item_id bigint, vector array<float>").repartition(7)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 500, 9)], "query_id bigint, vector array<float>")
    want = sorted(map(tuple, vectors.nearest(v, q, 5, rounded=6).collect()))
    monkeypatch.setattr(vectors, "FEW_QUERIES", 3)
    monkeypatch.setattr(vectors, "QUERY_SLICE", 10)
    near = vectors.nearest(v, q, 5, block=90, rounded=6)
    text = near._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in text and "Coalesce" in text
    assert sorted(map(tuple, near.collect())) == want and len(want) == 5 * 56
    monkeypatch.setattr(vectors, "FEW_NUMBERS", 3)
    assert sorted(map(tuple, vectors.nearest(v, q, 5, block=90, rounded=6).collect())) == want
