"""Problem 5: the k most similar vectors for every vector, by adaptive dimension scans.

Centroids are fitted on a bounded sample; every vector is indexed.  Lists of near centroids form
groups, and a group is the unit of work: it gets its vectors once and a copy of each query that
probes one of its lists.  Inside, vectors are rotated at random and cut into column blocks; after
each block a hypothesis test on the partial distance drops candidates that cannot be among the
query's nearest, so most candidates cost one block.  What survives is measured exactly.
Bit-identical vectors are one class with its smallest ids, so a group of copies, however large,
is one row.  Hot groups are cut into blocks of data and of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

DIM, K = 64, 5
#: Bound, but for a tenth, of the sample that centroids are fitted on; it is the only thing the driver collects.
SAMPLE = 20_000
#: Aimed-at vectors per list, lists per group, and the bounds at which a group is cut.
LIST_SIZE, GROUP_LISTS, DATA_BLOCK, QUERY_BLOCK = 400, 24, 80_000, 160_000
#: Vectors of a group as long as there are more lists than groups: where lists cannot grow in number, groups have fewer of them.
GROUP_SIZE = 60_000
#: A task compares so many rows with all centroids at once, so many queries with so many vectors, and measures so many pairs exactly at
#: once; it keeps the best of its candidates when there are more than these.  They bound memory and change no row.
ROWS, SCAN_QUERIES, SCAN_DATA, EXACT, CANDIDATES = 1024, 512, 2048, 50_000, 1_000_000
#: Column blocks of the scan and the tail of its test: a candidate is dropped if its scaled partial
#: distance exceeds the threshold by more than EPSILON standard errors.
COLUMNS, EPSILON = (0, 8, 16, 32, 64), 2.4


def usable(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    """(chunk_id, vector, stored_at) of vectors with dim finite numbers, not all zero."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return chunks.where(F.col("chunk_id").isNotNull() & (F.size(v) == dim)).where(fine).select("chunk_id", "vector", "stored_at")


def classes(chunks: DataFrame, dim: int = DIM, keep: int = K + 1) -> tuple[DataFrame, DataFrame]:
    """(classes, members): a class per distinct vector with its keep smallest ids and its size; members of classes above one.

    Rows of one chunk_id count once, the latest vector wins.  Only hashes travel with the ids; a
    vector is shuffled once, after a map-side combine.
    """
    u = usable(chunks, dim).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.reverse("vector"), F.lit(3))})
    latest = u.groupBy("chunk_id").agg(F.max(F.struct("stored_at", "h1", "h2")).alias("m")).select("chunk_id", "m.h1", "m.h2")
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("chunk_id"))
    small = latest.withColumn("r", rank).where(F.col("r") <= keep).groupBy("h1", "h2").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
    size = latest.groupBy("h1", "h2").agg(F.count("*").alias("size"))
    vectors = u.groupBy("h1", "h2").agg(F.first("vector").alias("vector"))
    c = vectors.join(small, ["h1", "h2"]).join(size, ["h1", "h2"]).select(F.col("ids")[0].alias("class_id"), "ids", "size", "vector")
    many = latest.join(size.where("size > 1"), ["h1", "h2"]).join(small, ["h1", "h2"]).select("chunk_id", F.col("ids")[0].alias("class_id"), "ids", "size")
    return c, many


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _exact(x: np.ndarray, q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the pairs of rows q and y of x, a bounded number of them at once."""
    s = np.empty(len(q))
    for a in range(0, len(q), EXACT):
        s[a : a + EXACT] = np.einsum("nd,nd->n", _unit(x[q[a : a + EXACT]]), _unit(x[y[a : a + EXACT]]))
    return s


def _closest(x: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The probes nearest centroids of each row of unit length, nearest first."""
    out = np.empty((len(x), probes), np.int32)
    for a in range(0, len(x), ROWS):
        near = x[a : a + ROWS] @ centroids.T
        np.negative(near, out=near)
        if probes < len(centroids):
            p = np.argpartition(near, probes - 1, axis=1)[:, :probes]
            out[a : a + ROWS] = np.take_along_axis(p, np.argsort(np.take_along_axis(near, p, 1), axis=1, kind="stable"), 1)
        else:
            out[a : a + ROWS] = np.argsort(near, axis=1, kind="stable")
    return out


def fit(sample: np.ndarray, lists: int, seed: int = 7, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; fewer lists if the sample is small."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample) // 4 or 1))
    x = sample.astype(np.float32)
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        a = np.argmax(x @ c.T, axis=1)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        n = np.linalg.norm(s, axis=1)
        c = np.where(n[:, None] > 1e-9, s / np.maximum(n, 1e-9)[:, None], c)
    return c


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scan(query: np.ndarray, data: np.ndarray, radius: np.ndarray, columns=COLUMNS, epsilon: float = EPSILON):
    """(query rows, data rows, squared distances) of pairs that no test dropped; radius is per query, squared.

    query and data are rotated unit vectors, data as a list of column blocks.
    """
    dim = columns[-1]
    first = slice(columns[0], columns[1])
    q, x = query[:, first], data[:, first]
    part = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T)
    d = columns[1]
    bound = radius * (d / dim) * (1 + epsilon / np.sqrt(d)) ** 2
    i, j = np.nonzero(part <= bound[:, None])
    dist = part[i, j]
    for a, b in zip(columns[1:-1], columns[2:]):
        if not len(i):
            break
        e = query[i, a:b] - data[j, a:b]
        dist = dist + np.einsum("nd,nd->n", e, e)
        ok = dist <= radius[i] * (1.0 if b == dim else (b / dim) * (1 + epsilon / np.sqrt(b)) ** 2)
        i, j, dist = i[ok], j[ok], dist[ok]
    return i, j, dist


def _best(ids, q, x, sim, k):
    """The k best of each q by sim and then id, as positions."""
    order = np.lexsort((ids[x], -sim, q))
    q = q[order]
    start = np.r_[True, q[1:] != q[:-1]]
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    return order[rank < k]


def neighbours(classes: DataFrame, k: int = K, probes: int = 6, least: float | None = None, queries=None, dim: int = DIM) -> DataFrame:
    """(class_id, other, similarity): for each query class the k most similar other classes within the probed lists.

    With least, only classes of at least that cosine, which lets the tests drop nearly everything
    in the first column block.  queries is a condition on class rows; default is every class.
    """
    spark = classes.sparkSession
    total = classes.count()
    # a hash picks the sample from all partitions alike; rounded up, it stays within SAMPLE but for chance, and the limit only bounds that
    picked = classes.where(F.pmod(F.xxhash64("class_id"), F.lit(max(1, -(-total // SAMPLE)))) == 0).select("vector").limit(SAMPLE + SAMPLE // 10).toPandas()
    schema = "class_id bigint, other bigint, similarity double"
    if not len(picked):
        return spark.createDataFrame([], schema)
    sample = _unit(np.stack(picked["vector"].to_numpy()))
    centroids = fit(sample, max(1, min(SAMPLE // 8, round(total / LIST_SIZE))))
    lists = len(centroids)
    groups = max(1, round(lists / GROUP_LISTS), min(lists // 4, -(-total // GROUP_SIZE)))
    top = fit(centroids, groups) if groups > 1 and lists >= 4 * groups else centroids[:1]
    group_of = np.argmax(centroids @ top.T, axis=1).astype(np.int32)
    # expected loads from the sample decide only how finely a hot group is cut, never what is in it
    home = np.argmax(sample.astype(np.float32) @ centroids.T, axis=1)
    load = np.bincount(group_of[home], minlength=len(top)) * (total / len(sample))
    cuts_d = np.maximum(1, np.ceil(load / DATA_BLOCK)).astype(np.int32)
    cuts_q = np.maximum(1, np.ceil(load * 2 / QUERY_BLOCK)).astype(np.int32)
    probes = min(probes, lists)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part.iloc[a : a + ROWS] for part in batches for a in range(0, len(part), ROWS)):
            x = _unit(np.stack(pdf["vector"].to_numpy())).astype(np.float32)
            p = _closest(x, centroids, probes)
            g = group_of[p]
            own = g[:, 0]
            ask = pdf["ask"].to_numpy(dtype=bool)
            rows, at, asks = [np.arange(len(x))], [own], [ask]
            for r in range(1, probes):  # further groups among the probed lists, each once
                new = ask & (g[:, r : r + 1] != g[:, :r]).all(axis=1)
                rows.append(np.flatnonzero(new))
                at.append(g[new, r])
                asks.append(np.ones(int(new.sum()), bool))
            rows, at, asks = np.concatenate(rows), np.concatenate(at), np.concatenate(asks)
            holds = np.r_[np.ones(len(x), bool), np.zeros(len(rows) - len(x), bool)]
            cd, cq = cuts_d[at], cuts_q[at]
            ids = pdf["class_id"].to_numpy()
            salt = (ids * np.int64(-7046029254386353131)).view(np.uint64) >> np.uint64(40)
            out = {"rows": [], "key": [], "holds": [], "asks": []}
            for b in range(int((cd * cq).max())):  # one round unless a group is hot
                d_at, q_at = b // cq, b % cq
                here = b < cd * cq
                h = here & holds & (salt[rows] % cd.astype(np.uint64) == d_at.astype(np.uint64))
                s = here & asks & ((salt[rows] >> np.uint64(8)) % cq.astype(np.uint64) == q_at.astype(np.uint64))
                take = h | s
                out["rows"].append(rows[take])
                out["key"].append(at[take].astype(np.int64) * 1_000_003 + b)
                out["holds"].append(h[take])
                out["asks"].append(s[take])
            r = np.concatenate(out["rows"])
            yield pd.DataFrame({"key": np.concatenate(out["key"]), "class_id": ids[r], "holds": np.concatenate(out["holds"]), "asks": np.concatenate(out["asks"]), "vector": pdf["vector"].to_numpy()[r]})

    turn = rotation(dim)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        x32 = np.stack(pdf["vector"].to_numpy())
        ids, holds, asks = pdf["class_id"].to_numpy(), pdf["holds"].to_numpy(bool), pdf["asks"].to_numpy(bool)
        dr, qr = np.flatnonzero(holds), np.flatnonzero(asks)
        if not len(dr) or not len(qr):
            return pd.DataFrame({"class_id": [], "other": [], "similarity": []})
        turned, close = np.empty(x32.shape, np.float32), np.empty((len(x32), probes), np.int32)
        for a in range(0, len(x32), ROWS):
            unit = _unit(x32[a : a + ROWS])
            turned[a : a + ROWS] = unit @ turn
            close[a : a + ROWS] = _closest(unit.astype(np.float32), centroids, probes)
        home, part = close[dr, 0], close[qr]
        radius = np.full(len(qr), 4.0 if least is None else (2 - 2 * least) * (1 + 1e-5), np.float32)
        members = {int(c): dr[home == c] for c in np.unique(home)}
        got_q, got_x, got_s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for rank in range(part.shape[1]):
            qs, xs = [], []
            for c in np.unique(part[:, rank]):
                m = members.get(int(c))
                if m is None:
                    continue
                q = np.flatnonzero(part[:, rank] == c)
                for a in range(0, len(q), SCAN_QUERIES):
                    for z in range(0, len(m), SCAN_DATA):
                        i, j, _ = scan(turned[qr[q[a : a + SCAN_QUERIES]]], turned[m[z : z + SCAN_DATA]], radius[q[a : a + SCAN_QUERIES]])
                        i, j = q[a : a + SCAN_QUERIES][i], m[z : z + SCAN_DATA][j]
                        other = qr[i] != j
                        other &= ids[qr[i]] != ids[j]
                        qs.append(i[other])
                        xs.append(j[other])
                        if sum(map(len, qs)) > max(CANDIDATES, 4 * k * len(qr)):  # long lists without a threshold: keep the best as they come
                            q1, x1 = np.concatenate(qs), np.concatenate(xs)
                            keep = _best(ids, q1, x1, _exact(x32, qr[q1], x1), k)
                            qs, xs = [q1[keep]], [x1[keep]]
            if not qs:
                continue
            q, x = np.concatenate(qs), np.concatenate(xs)
            s = _exact(x32, qr[q], x)
            if least is not None:
                ok = s >= least
                q, x, s = q[ok], x[ok], s[ok]
            got_q, got_x, got_s = np.r_[got_q, q], np.r_[got_x, x], np.r_[got_s, s]
            keep = _best(ids, got_q, got_x, got_s, k)
            got_q, got_x, got_s = got_q[keep], got_x[keep], got_s[keep]
            if len(got_q):  # the k-th best so far is the next radius
                n = np.bincount(got_q, minlength=len(qr))
                worst = np.full(len(qr), 2.0)
                np.minimum.at(worst, got_q, got_s)
                full = n >= k
                radius[full] = np.minimum(radius[full], ((2 - 2 * worst[full]) * (1 + 1e-5) + 1e-6).astype(np.float32))
        return pd.DataFrame({"class_id": ids[qr[got_q]], "other": ids[got_x], "similarity": got_s})

    ask = F.lit(True) if queries is None else queries
    placed = classes.select("class_id", "vector", ask.alias("ask")).mapInPandas(spread, "key bigint, class_id bigint, holds boolean, asks boolean, vector array<float>")
    n = common.tasks(spark)
    hits = placed.repartition(n, "key").groupBy("key").applyInPandas(search, schema)
    best = F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("similarity"), "other"))
    return hits.withColumn("r", best).where(F.col("r") <= k).drop("r")


def pairs(chunks: DataFrame, k: int = K, probes: int = 6, least: float = 0.9, dim: int = DIM) -> DataFrame:
    """(chunk_id_a, chunk_id_b): pairs of at least that cosine in which one is among the other's k nearest, ties to the smaller id.

    Null, short, long, non-finite and all-zero vectors do not count; an empty table gives no rows.
    """
    c, many = classes(chunks, dim, k + 1)
    c = common.materialize(c)
    near = neighbours(c, k, probes, least, dim=dim)
    meta = c.select("class_id", "ids", "size")
    # ids of other classes, best class first, smaller ids first within equal similarity
    other = near.join(meta.select(F.col("class_id").alias("other"), F.col("ids").alias("other_ids")), "other")
    flat = other.select("class_id", "similarity", F.explode("other_ids").alias("id"))
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("similarity"), "id"))
    foreign = flat.withColumn("r", rank).where(F.col("r") <= k)
    single = foreign.select(F.col("class_id").alias("a"), F.col("id").alias("b")).join(meta.where("size = 1").select(F.col("class_id").alias("a")), "a", "left_semi")
    inside = many.select(F.col("chunk_id").alias("a"), F.explode(F.expr(f"slice(filter(ids, x -> x <> chunk_id), 1, {k})")).alias("b"))
    outside = many.where(F.col("size") <= k).join(foreign, "class_id").where(F.col("r") <= k - (F.col("size") - 1)).select(F.col("chunk_id").alias("a"), F.col("id").alias("b"))
    both = single.unionByName(inside).unionByName(outside)
    return both.select(F.least("a", "b").alias("chunk_id_a"), F.greatest("a", "b").alias("chunk_id_b")).distinct()


def search_every(chunks: DataFrame, every: int = 20, k: int = K, probes: int = 64, dim: int = DIM) -> DataFrame:
    """(chunk_id, neighbour, similarity): queries are the vectors whose id is divisible by every, searched in all vectors.

    Neighbours are classes of identical vectors, by their smallest id.
    """
    c, many = classes(chunks, dim, k + 1)
    c = common.materialize(c)
    asks = F.exists("ids", lambda x: x % every == 0) | (F.col("size") > k + 1)
    near = neighbours(c, k, probes, None, asks, dim)
    ids = c.where("size = 1").select("class_id", F.col("class_id").alias("chunk_id")).unionByName(many.select("class_id", "chunk_id")).where(F.col("chunk_id") % every == 0)
    return ids.join(near, "class_id").select("chunk_id", F.col("other").alias("neighbour"), F.round("similarity", 6).alias("similarity"))
