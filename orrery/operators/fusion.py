"""Fusion of ranked sources, re-ranking, hypothetical documents and tiers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
# Weights by query class and source: which source the class leans on.
WEIGHTS = {
    "Symbol": {"vector": 0.6, "lexical": 1.4, "path": 1.2, "symbol": 1.6},
    "NaturalLanguage": {"vector": 1.6, "lexical": 0.8, "path": 0.5, "symbol": 0.5},
    "CodePattern": {"vector": 1.1, "lexical": 1.1, "path": 0.7, "symbol": 1.0},
    "PathQuery": {"vector": 0.5, "lexical": 0.8, "path": 1.8, "symbol": 0.5},
}
POOL, RERANK_SHARE, HYDE_SHARE = 60, 0.70, 0.3
TIER_FROM, TIER_KEEP = 200, 30


def weights(spark) -> DataFrame:
    rows = [(c, s, w) for c, ws in WEIGHTS.items() for s, w in ws.items()]
    return spark.createDataFrame(rows, "query_class string, source string, weight double")


def fuse(hits: DataFrame, classes: DataFrame, k: int = 100, digits: int = 9) -> DataFrame:
    """(query_id, id, score, rank) from hits (query_id, source, id, rank from 0) and classes (query_id, query_class).

    score is the sum of weight / (60 + rank + 1).  The weight table has sixteen rows.
    """
    w = F.broadcast(weights(hits.sparkSession))
    j = hits.join(classes, "query_id").join(w, ["query_class", "source"])
    s = j.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") / (RRF_K + F.col("rank") + 1)), digits).alias("score"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return s.withColumn("rank", r).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def overlap_grade(pairs: list[tuple[str, str]]) -> list[float]:
    """A deterministic stand-in for a model that grades the relevance of (query, text) pairs from 0 to 10."""
    import re

    out = []
    for query, text in pairs:
        q, t = (set(re.findall(r"\w+", (x or "").lower())) for x in (query, text))
        out.append(10.0 * len(q & t) / len(q) if q else 0.0)
    return out


def rerank(candidates: DataFrame, grade=overlap_grade, batch: int = 8, pool: int = POOL) -> DataFrame:
    """(query_id, id, score): the pool best of (query_id, id, score, query, text), 0.7 of the grade / 10 plus 0.3 of the score.

    grade gets lists of at most batch (query, text) pairs; candidates beyond the pool are left out.
    """
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return graded(candidates.withColumn("r", r).where(F.col("r") <= pool).drop("r"), grade, batch)


def graded(candidates: DataFrame, grade=overlap_grade, batch: int = 8) -> DataFrame:
    """``rerank`` of all candidates, where the pool is cut already; nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = list(zip(pdf["query"], pdf["text"]))
            grades = [float(g) for at in range(0, len(pairs), batch) for g in grade(pairs[at : at + batch])]
            yield pd.DataFrame({"query_id": pdf["query_id"], "id": pdf["id"], "score": pdf["score"], "grade": grades})

    g = candidates.select("query_id", "id", "score", "query", "text").mapInPandas(run, "query_id bigint, id bigint, score double, grade double")
    return g.select("query_id", "id", F.round(RERANK_SHARE * F.col("grade") / 10 + (1 - RERANK_SHARE) * F.col("score"), 9).alias("score"))


def hyde_blend(original: DataFrame, hypothetical: DataFrame) -> DataFrame:
    """(query_id, id, score): 0.7 of the original score and 0.3 of the hypothetical document's, a missing side counts 0."""
    j = original.select("query_id", "id", F.col("score").alias("a")).join(hypothetical.select("query_id", "id", F.col("score").alias("b")), ["query_id", "id"], "full_outer")
    return j.select("query_id", "id", F.round((1 - HYDE_SHARE) * F.coalesce("a", F.lit(0.0)) + HYDE_SHARE * F.coalesce("b", F.lit(0.0)), 9).alias("score"))


def tier(hits: DataFrame, projects: DataFrame, least: int = TIER_FROM, keep: int = TIER_KEEP) -> DataFrame:
    """hits (query_id, id, project, score) of each query's keep best projects, by their best hit; all hits below least projects.

    A project is ranked by a window over the hits, which are computed once.
    """
    n = projects.select("project").distinct().agg(F.count("*")).scalar()
    best = F.max("score").over(Window.partitionBy("query_id", "project"))
    r = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("best_"), "project"))
    top = hits.withColumn("best_", best).withColumn("r_", r).withColumn("n_", n)
    return top.where(((F.col("r_") <= keep) | (F.col("n_") < least)) & ((F.col("n_") < least) | F.col("project").isNotNull())).select(hits.columns)
