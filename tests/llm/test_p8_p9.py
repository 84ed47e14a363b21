import numpy as np
import pytest

from orrery.llm import p8_pack, p9_mix, sizes
from orrery.llm.tokenizer import byte_bpe
from orrery.shipping import ship

SCHEMA = "doc_id bigint, text string, source string, n_tokens int, container string, curve int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "clash", 1) for i, t, s in rows], SCHEMA)


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(["amber", "kelp", "lattice", "window", "number", "don't", "größe"], n))


def test_sizes(spark):
    ship(spark)
    rows = [(1, "hello world", "a"), (2, None, "a"), (3, "", "a"), (4, words(3000, 1), "a"), (5, "<|endoftext|>", None)]
    got = {r.doc_id: r.n_tokens for r in sizes.sized(frame(spark, rows), ["doc_id"]).collect()}
    enc = byte_bpe()
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t, _ in rows}


def test_hilbert_is_a_walk():
    """Every cell once, and each step goes to a neighbouring cell."""
    for dims, bits in ((2, 3), (3, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = sizes.hilbert(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("n", [0, 1, 300])
def test_packing(spark, n):
    ship(spark)
    rng = np.random.default_rng(2)
    rows = [(i, words(int(rng.integers(1, 400)), i), "a") for i in range(n)]
    if n > 1:
        rows += [(n, words(3000, 9), "a"), (n + 1, None, "a"), (n + 2, "", "a")]
    docs = frame(spark, rows)
    limits = spark.createDataFrame([("small", 128), ("large", 1000), ("none", None), ("zero", 0)], "container string, capacity_tokens int")
    got = p8_pack.pack(docs, limits).collect()
    size = {i: len(byte_bpe().encode_ordinary(t or "")) for i, t, _ in rows}
    for cap in (128, 1000):
        parts, used = {}, {}
        for r in got:
            if r.capacity == cap:
                parts.setdefault(r.doc_id, []).append((r.piece, r.token_start, r.token_end))
                used[r.container_id] = used.get(r.container_id, 0) + r.token_end - r.token_start
        assert set(parts) == set(size)
        for i, p in parts.items():
            p.sort()
            assert [x[0] for x in p] == list(range(len(p))) and p[0][1] == 0 and p[-1][2] == size[i]
            assert all(a[2] == b[1] for a, b in zip(p, p[1:]))
            assert len(p) == 1 or size[i] > cap
        assert max(used.values(), default=0) <= cap
        if n > 1:
            # one that is too large for half a container fills at least its own
            floor = max(-(-sum(size.values()) // cap), sum(s % cap > cap / 2 for s in size.values() if s <= cap))
            assert len(used) <= 1.15 * floor + 2
    if n:
        rep = {r.capacity: r for r in p8_pack.report(p8_pack.pack(docs, limits)).collect()}
        assert rep[128].tokens == sum(size.values()) and rep[128].fullest <= 128


def test_mixture(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for source, n in (("Big Wiki", 900), ("big-wiki ", 100), ("small", 120), ("BIG_WIKI", 50), (None, 30), ("", 5), ("unasked", 40)):
        for _ in range(n):
            rows.append((i, words(int(rng.integers(1, 60)), i), source))
            i += 1
    rows.append((i, None, "small"))
    targets = spark.createDataFrame([("big wiki", 0.5, 1), ("Small", 0.3, 3), ("missing", 0.2, 9), ("bad", -1.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    m, p = p9_mix.mix(frame(spark, rows), targets)
    s = {r.source: r for r in p9_mix.shares(m, p).collect()}
    assert set(s) == {"big-wiki", "small", "missing"}
    assert s["missing"].mixed_tokens == 0 and s["big-wiki"].documents == 1050
    assert abs(s["big-wiki"].share - 0.625) < 0.02 and abs(s["small"].share - 0.375) < 0.02
    assert s["small"].most_copies <= 3 and s["big-wiki"].most_copies <= 1
    again, _ = p9_mix.mix(frame(spark, rows), targets)
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, again.collect()))


def test_hot_sources_in_blocks(spark):
    ship(spark)
    d = spark.createDataFrame([(i, "s" if i % 3 else "t", 10 + i % 50) for i in range(3000)], "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame([("s", 0.4, 4), ("t", 0.6, 2)], "source string, target_share double, max_repeats int")
    p = p9_mix.plan(d, t)
    whole, cut = p9_mix.mixture(d, p), p9_mix.mixture(d, p, block=100)
    assert whole.count() == pytest.approx(cut.count(), abs=2)
    for r in p9_mix.shares(cut, p).collect():
        assert abs(r.share - r.target_share) < 0.005 and r.most_copies <= r.max_repeats


def test_nothing_to_mix(spark):
    ship(spark)
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert p9_mix.mix(frame(spark, []), t)[0].count() == 0
    assert p9_mix.mix(frame(spark, [(1, "x y", "a")]), t.limit(0))[0].count() == 0
    assert p9_mix.mix(frame(spark, [(1, "x y", "a")]), t)[0].count() == 1


def test_containers_stay_close_on_the_curve():
    import random
    from collections import defaultdict

    random.seed(2)
    sizes_ = [random.choice((40, 90, 150, 300, 420, 900, 2500)) for _ in range(5000)]
    packer, rows = p8_pack.Packer("c", 2048, 0), []
    for at in range(0, len(sizes_), p8_pack.WINDOW):
        rows += packer.add([(n, at + k) for k, n in enumerate(sizes_[at : at + p8_pack.WINDOW])])
    used, members = defaultdict(int), defaultdict(list)
    for _, _, c, doc, _, a, b in rows:
        used[c] += b - a
        members[c].append(doc)
    assert max(used.values()) <= 2048 and sum(used.values()) == sum(sizes_)
    assert 1 - sum(sizes_) / (len(used) * 2048) < 0.02
    spans = sorted(max(m) - min(m) for m in members.values() if len(m) > 1)
    assert spans[len(spans) // 2] < 2 * p8_pack.WINDOW


def test_too_many_capacities_raise(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    limits = spark.createDataFrame([(f"c{i}", i + 1) for i in range(p8_pack.MOST_CAPACITIES + 1)], "container string, capacity_tokens int")
    with pytest.raises(ValueError):
        p8_pack.pack(docs, limits)
