"""Context packing: dedup, diversity, budget, order and whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

JACCARD, PER_FILE, PER_PROJECT, POOL = 0.5, 3, 8, 60


def dedup(hits: DataFrame, pool: int = POOL, limit: float = JACCARD) -> DataFrame:
    """hits (query_id, id, score, text, ...) of each query's pool best, but those that share more than limit of their
    distinct tokens with a better one that was kept.

    The greedy pass is a fold over at most pool sorted structs, inside the JVM; only ids and token
    sets are gathered, and never more than pool rows of a query.
    """
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    top = hits.withColumn("r_", r).where(F.col("r_") <= pool)
    g = top.select("query_id", F.struct("r_", "id", F.array_distinct(tokens(F.col("text"))).alias("t")).alias("s")).groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    kind = "array<struct<r_:int,id:bigint,t:array<string>>>"
    near = f"exists(kept, y -> size(array_intersect(y.t, x.t)) > {limit} * size(array_union(y.t, x.t)))"
    kept = F.expr(f"aggregate(s, cast(array() as {kind}), (kept, x) -> if({near}, kept, array_append(kept, x)))")
    ids = g.select("query_id", F.transform(kept, lambda x: x["id"]).alias("kept_"))
    return top.join(ids, "query_id").where(F.array_contains("kept_", F.col("id"))).select(hits.columns)  # by the query alone, as both sides lie: texts are not shuffled again


def diverse(hits: DataFrame, per_file: int = PER_FILE, per_project: int = PER_PROJECT) -> DataFrame:
    """hits (query_id, id, score, file_id, project): at most per_file of a file, then per_project of a project, best first."""
    order = (F.desc("score"), F.col("id"))
    a = F.row_number().over(Window.partitionBy("query_id", "file_id").orderBy(*order))
    b = F.row_number().over(Window.partitionBy("query_id", "project").orderBy(*order))
    return hits.withColumn("a_", a).where(F.col("a_") <= per_file).withColumn("b_", b).where(F.col("b_") <= per_project).select(hits.columns)


def within_budget(hits: DataFrame, budget: int) -> DataFrame:
    """The best hits of each query while their texts together stay within budget characters; the first that exceeds it ends the list."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used_", F.sum(F.length(F.coalesce("text", F.lit("")))).over(w)).where(F.col("used_") <= budget).select(hits.columns)


def coherent(hits: DataFrame) -> DataFrame:
    """hits with position from 1: files by their best score, a file's chunks in reading order."""
    best = F.max("score").over(Window.partitionBy("query_id", "file_id"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best_"), "file_id", "chunk_index", "id"))
    return hits.withColumn("best_", best).withColumn("position", order).drop("best_")


def pack(hits: DataFrame, budget: int = 12_000) -> DataFrame:
    """Dedup, then caps, then budget, then order."""
    return coherent(within_budget(diverse(dedup(hits)), budget))


def documents(pieces: DataFrame, key: str = "file_id", index: str = "chunk_index") -> DataFrame:
    """(key, text): whole documents stitched from their pieces in order, blank lines between the pieces' lines kept.

    Repeated pieces (same index and start) count once, the latest or greatest text wins.
    """
    one = pieces.where(F.col(key).isNotNull()).groupBy(key, index, F.coalesce("line_start", F.lit(1)).alias("a")).agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("t"), F.coalesce("line_end", "line_start", F.lit(1)).alias("b"))).alias("m"))
    g = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("a", index, F.col("m.b").alias("b"), F.col("m.t").alias("t")))).alias("p"))
    text = F.expr("array_join(transform(p, (x, i) -> concat(repeat('\n', greatest(0, x.a - if(i = 0, 1, p[i - 1].b))), x.t)), '')")
    return g.select(key, text.alias("text"))
