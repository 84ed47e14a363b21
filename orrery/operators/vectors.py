"""Vector search: exact nearest neighbours and the normalised score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import similarity

_EPSILON = 2.220446049250313e-16  # fixed value: the span below which all scores are one


def normalize_distances(hits: DataFrame, by: list[str], item: str) -> DataFrame:
    """by, item, score: the best similarity 1 / (1 + distance) per item, stretched to [0, 1] within by.

    All scores are 1 where the span is nothing, as for a single hit; null distances are skipped.
    """
    best = hits.where("distance is not null").groupBy(*by, item).agg(F.max(similarity(F.col("distance"))).alias("sim"))
    w = Window.partitionBy(*by)
    low, high = F.min("sim").over(w), F.max("sim").over(w)
    score = F.when(high - low < _EPSILON, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("sim") - low) / (high - low))))
    return best.withColumn("score", score).drop("sim")


#: So many queries, of so many numbers together, are sent to every task; more are cut into blocks.
FEW_QUERIES, FEW_NUMBERS = 2048, 4_000_000
#: Queries that meet a block of vectors at once where all of them are sent to the tasks: a task holds the rows of so many.
QUERY_SLICE = 4096
#: Queries of a block: vectors are shuffled once for each of these blocks, so they are as large as a task's memory allows.
QUERY_BLOCK = 20_000


def _stack(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def _topk(ids: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, squared: bool, rounded: int | None):
    """(query rows, ids, distances) of the k nearest x of each y, ties to the smaller id."""
    rows, items, dist = [], [], []
    norm = (x * x).sum(1)
    take = min(len(ids), k + 32)
    for at in range(0, len(y), 64):  # so many rows of distances are held at once
        q = y[at : at + 64]
        rough = (q * q).sum(1)[:, None] + norm[None, :] - 2 * q @ x.T
        near = np.argpartition(rough, take - 1, axis=1)[:, :take]
        bound = np.take_along_axis(rough, near, 1).max(1) + 1e-9
        more = (rough <= bound[:, None]).sum(1) > take if take < len(ids) else np.zeros(len(q), bool)
        parts = [(np.flatnonzero(~more), near[~more])] + [(np.array([r]), np.flatnonzero(rough[r] <= bound[r])[None, :]) for r in np.flatnonzero(more)]  # more could tie with the last one than were taken
        for who, c in parts:
            d = ((x[c] - q[who][:, None, :]) ** 2).sum(2)
            d = d if squared else np.sqrt(d)
            d = d if rounded is None else np.round(d, rounded)
            o = np.lexsort((ids[c], d), axis=1)[:, :k]
            rows.append(np.repeat(who + at, o.shape[1]))
            items.append(np.take_along_axis(ids[c], o, 1).ravel())
            dist.append(np.take_along_axis(d, o, 1).ravel())
    return np.concatenate(rows), np.concatenate(items), np.concatenate(dist)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, squared: bool = True, block: int = 100_000, rounded: int | None = None) -> DataFrame:
    """(query_id, item_id, distance): the max(k, 1) nearest vectors of each query by L2 distance, ties to the smaller id.

    vectors are (item_id, vector), queries (query_id, vector).  Up to FEW_QUERIES queries of
    FEW_NUMBERS numbers are sent to the tasks that scan the vectors, of which none is shuffled: a
    task lets only its k best per query go.  More queries of no more numbers are sent too, to few
    tasks, each of which takes a block of vectors and one slice of the queries after another.  Still
    more are cut into blocks, as are the vectors, and a pair of blocks is one matrix product.  Null vectors and vectors of another length than
    the query's do not match.  rounded digits make ties of nearly equal distances.
    """
    k = max(k, 1)
    vectors = vectors.where("vector is not null and item_id is not null").select("item_id", "vector")
    queries = queries.where("vector is not null and query_id is not null").select("query_id", F.col("vector").alias("qv"))
    schema = "query_id bigint, item_id bigint, distance double"

    def multiply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        sizes = left["vector"].map(len)
        for dim, part in right.groupby(right["qv"].map(len)):
            same = left[sizes == dim]
            if not len(same) or not dim:
                continue
            r, i, d = _topk(same["item_id"].to_numpy(), _stack(same["vector"]), _stack(part["qv"]), k, squared, rounded)
            out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[r], "item_id": i, "distance": d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "item_id": [], "distance": []})

    size = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("qv")), F.lit(0))).first()
    if size[0] <= FEW_QUERIES and size[1] <= FEW_NUMBERS:
        few = queries.toPandas()

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for pdf in batches:
                got = multiply(pdf, few)
                best = got if best is None else pd.concat([best, got])
                if len(best) > 4 * k * max(1, len(few)):
                    best = best.sort_values(["query_id", "distance", "item_id"]).groupby("query_id").head(k)
            if best is not None and len(best):
                yield best.sort_values(["query_id", "distance", "item_id"]).groupby("query_id").head(k)

        hits = vectors.mapInPandas(scan, schema)
    elif size[1] <= FEW_NUMBERS:
        many = queries.toPandas()

        def against(left: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            whole = pd.concat(left)
            for at in range(0, len(many), QUERY_SLICE):
                yield multiply(whole, many.iloc[at : at + QUERY_SLICE])

        def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, n = [], 0
            for pdf in batches:
                held.append(pdf)
                n += len(pdf)
                if n >= 1.5 * block:  # partitions are not quite even, and a small rest would give as many rows as a block
                    yield from against(held)
                    held, n = [], 0
            if n:
                yield from against(held)

        hits = vectors.coalesce(max(1, -(-vectors.count() // block))).mapInPandas(gather, schema)
    else:
        nv, nq = max(1, -(-vectors.count() // block)), max(1, -(-size[0] // QUERY_BLOCK))
        v = vectors.withColumn("vb", F.pmod(F.xxhash64("item_id"), F.lit(nv))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<bigint>")))
        q = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(nq))).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1)).cast("array<bigint>")))
        v, q = (x.repartition(nv * nq, "qb", "vb").groupBy("qb", "vb") for x in (v, q))  # a pair of blocks is long work, small as it is
        hits = v.cogroup(q).applyInPandas(multiply, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "item_id"))
    return hits.where("not isnan(distance)").withColumn("r", rank).where(F.col("r") <= k).drop("r")


def search(vectors: DataFrame, queries: DataFrame, k: int, rounded: int | None = None) -> DataFrame:
    """(query_id, item_id, score) of ``nearest`` with normalised scores."""
    return normalize_distances(nearest(vectors, queries, k, rounded=rounded), ["query_id"], "item_id")


def embed(texts: DataFrame, embedder, batch: int = 24, retries: int = 3, wait: float = 0.0) -> DataFrame:
    """(id, vector): texts embedded in groups of batch by a callable list[str] -> list of vectors, with retries and growing waits.

    A group that still fails ends the task, so that no text is lost in silence.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                for attempt in range(retries + 1):
                    try:
                        got = embedder(part["text"].fillna("").tolist())
                        break
                    except Exception:
                        if attempt == retries:
                            raise
                        time.sleep(wait * 2**attempt)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vector": [np.asarray(g, np.float32) for g in got]})

    return texts.select("id", "text").mapInPandas(run, "id bigint, vector array<float>")


def hashed_words(dim: int = 64):
    """A deterministic embedder for tests and offline use: signed hashed words, unit length."""

    def run(texts: list[str]) -> list[np.ndarray]:
        import re
        import zlib

        out = []
        for t in texts:
            v = np.zeros(dim, np.float32)
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h & 65536 else -1.0
            n = float(np.linalg.norm(v))
            out.append(v / n if n else v)
        return out

    return run
