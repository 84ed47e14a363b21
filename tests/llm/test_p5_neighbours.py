import numpy as np

from orrery.llm import p5_neighbours as p5
from orrery.shipping import ship

SCHEMA = "chunk_id bigint, vector array<float>, stored_at timestamp, size int, class_id string"


def brute(ids, x, k=5, least=0.9):
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    out = set()
    for i in range(len(ids)):
        s = np.round(unit @ unit[i], 12)
        s[i] = -9
        for j in np.lexsort((ids, -s))[:k]:
            if s[j] >= least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return {(int(a), int(b)) for a, b in out}


def frame(spark, ids, x, extra=()):
    rows = [(int(i), [float(f) for f in v], None, 1, "c") for i, v in zip(ids, x)] + list(extra)
    return spark.createDataFrame(rows, SCHEMA)


def data(n=600, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 64))
    for i in range(0, n, 4):  # groups of near copies
        base[i + 1 : i + 1 + i % 3] = base[i] + 0.2 * rng.standard_normal((i % 3, 64))
    return np.arange(n) * 3, (base * rng.uniform(0.5, 2, (n, 1))).astype(np.float32)


def test_pairs_are_brute_force(spark):
    ship(spark)
    ids, x = data()
    x[5:17] = x[40]  # a group of copies larger than k
    x[100:102] = x[200]
    bad = [(9001, None, None, 1, "c"), (9002, [1.0] * 63, None, 1, "c"), (9003, [float("nan")] * 64, None, 1, "c"), (9004, [0.0] * 64, None, 1, "c"), (9005, [float("inf")] + [0.0] * 63, None, 1, "c"), (9006, [None] * 64, None, 1, "c"), (None, [1.0] * 64, None, 1, "c")]
    df = frame(spark, ids, x, bad)
    got = {tuple(r) for r in p5.pairs(df.unionByName(df.limit(50))).collect()}  # with repeated rows
    want = brute(ids, x)
    assert not got - want and len(want - got) <= 0.02 * len(want)


def test_hot_groups_are_cut(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(p5, "DATA_BLOCK", 60)
    monkeypatch.setattr(p5, "QUERY_BLOCK", 70)
    ids, x = data(400, 3)
    got = {tuple(r) for r in p5.pairs(frame(spark, ids, x)).collect()}
    want = brute(ids, x)
    assert not got - want and len(want - got) <= 0.02 * len(want)


def test_search_recall(spark):
    ship(spark)
    ids, x = data(2000, 5)
    got = {}
    for r in p5.search_every(frame(spark, ids, x), 20).collect():
        got.setdefault(r.chunk_id, set()).add(r.neighbour)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for i in got:
        s = unit @ unit[i // 3]
        s[i // 3] = -9
        hit += len(got[i] & {int(ids[j]) for j in np.argsort(-s)[:5]})
    assert hit >= 0.9 * 5 * len(got)


def test_the_scan_drops_no_near_pair():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.02 * rng.standard_normal(x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    turn = p5.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    a, b = (x @ turn).astype(np.float32), (y @ turn).astype(np.float32)
    i, j, d = p5.scan(a, b, np.full(500, 0.2, np.float32))
    near = {(p, q) for p, q in zip(*np.nonzero(((x[:, None] - y[None]) ** 2).sum(-1) <= 0.2))}
    assert {(p, q) for p, q in zip(i, j)} == near and len(near) >= 490


def test_few_and_none(spark):
    ship(spark)
    x = np.eye(64, dtype=np.float32)[:2]
    assert p5.pairs(frame(spark, [1, 2], x)).count() == 0
    assert p5.pairs(frame(spark, [1, 2], x[[0, 0]])).collect() == [(1, 2)]
    assert p5.pairs(frame(spark, [1], x[:1])).count() == 0
    assert p5.pairs(frame(spark, [1], x[:1]).limit(0)).count() == 0


def test_large_group_stays_in_memory():
    """Cosines of many pairs and the nearest of many centroids are taken a bounded number at once, and are the plain ones."""
    import tracemalloc

    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 64)).astype(np.float32)
    q, y = rng.integers(0, 2000, 600_000), rng.integers(0, 2000, 600_000)
    c = p5.fit(p5._unit(x), 200)
    tracemalloc.start()
    s = p5._exact(x, q, y)
    near = p5._closest(np.tile(p5._unit(x).astype(np.float32), (20, 1)), c, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    u = p5._unit(x)
    assert np.array_equal(s[::997], np.einsum("nd,nd->n", u[q[::997]], u[y[::997]]))
    assert np.array_equal(near[:2000, 0], np.argmax(u.astype(np.float32) @ c.T, axis=1))
    assert peak < 250e6  # all at once would take 614 MB for the pairs
