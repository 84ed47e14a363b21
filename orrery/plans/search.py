"""The composed retrieval pipeline over the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_class
from ..operators import fusion, graph, lexical, packing, vectors


#: The order in which rows of a chunk are told apart: the time, then what is small, the text last.
_LATEST = ["indexed_at", "file_id", "project", "chunk_index", "line_start", "line_end", "kind", "symbol_name", "rel_path", "text"]


def latest_chunks(chunks: DataFrame, *columns: str) -> DataFrame:
    """One row per chunk_id, the latest, with these columns, or all that search needs.

    What stands behind the last of them is not shuffled; the row is the same whichever are asked for.
    """
    columns = columns or tuple(_LATEST)
    m = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.max(F.struct(*_LATEST[: max(map(_LATEST.index, columns)) + 1])).alias("m"))
    return m.select("chunk_id", *[f"m.{x}" for x in columns])


def latest_vectors(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """(item_id, vector) of finite vectors of one length, the latest of each id."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))
    m = chunks.where(F.col("chunk_id").isNotNull() & (F.size("vector") == dim)).where(fine).groupBy("chunk_id").agg(F.max(F.struct("stored_at", "vector")).alias("m"))
    return m.select(F.col("chunk_id").alias("item_id"), "m.vector")


def sources(chunks: DataFrame, near: DataFrame, queries: DataFrame, k: int = 20, light: DataFrame | None = None) -> DataFrame:
    """(query_id, source, id, rank) of the four sources for queries (query_id, text) and what is ``nearest`` to their vectors, k or more."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "item_id"))
    v = near.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.lit("vector").alias("source"), F.col("item_id").alias("id"), (F.col("rank") - 1).alias("rank"))
    named = lambda hits, source: hits.select("query_id", F.lit(source).alias("source"), "id", "rank")
    lex = lexical.bm25(chunks.select(F.col("chunk_id").alias("id"), "text"), queries, k)
    c = (chunks if light is None else light).withColumnRenamed("chunk_id", "id")
    path = lexical.path_matches(c.where("rel_path is not null").select("id", F.col("rel_path").alias("path")), queries, k)
    sym = lexical.symbol_prefix(c.select("id", F.col("symbol_name").alias("name")), queries, k)
    return v.unionByName(named(lex, "lexical")).unionByName(named(path, "path")).unionByName(named(sym, "symbol"))


def fused(chunks: DataFrame, stored: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int = 20, near: DataFrame | None = None, light: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the sources fused with the weights of each query's class; near, if it is there, are k or more nearest.

    light, if it is there, are the chunks without their texts, so that only BM25 moves those.
    """
    if near is None:
        near = vectors.nearest(stored, query_vectors, k, rounded=6)
    classes = queries.select("query_id", query_class(F.col("text")).alias("query_class"))
    return fusion.fuse(sources(chunks, near, queries, k, light), classes, k)


#: Chunks of a query that seed the expansion, and the nearest chunks of the query that it may draw in.
SEEDS, REACH = 5, 60


def expand(hits: DataFrame, near: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, id, score): hits (query_id, id, project, score) with what their best chunks reach through the project graph.

    near (query_id, id, project, similarity in 0..1) are the chunks that may be drawn in.  One in a
    seed's own project gets the seed's score times the same-project weight of its similarity, one in
    a project within two hops times the weight of the way there; of several scores the best counts.
    """
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    seeds = hits.where("project is not null").withColumn("r", best).where(F.col("r") <= SEEDS).groupBy("query_id", "project").agg(F.max("score").alias("seed_score"))
    ways = graph.expand(seeds.select("project"), edges).select(F.col("seed"), F.col("project").alias("to"), "weight")
    reach = seeds.join(ways, F.col("project") == F.col("seed")).select("query_id", "seed_score", "to", (F.col("seed") == F.col("to")).alias("own"), "weight")
    drawn = near.join(reach.withColumnRenamed("to", "project"), ["query_id", "project"])
    w = F.when(F.col("own"), graph.same_project_weight(F.col("similarity"))).otherwise(F.col("weight"))
    drawn = drawn.select("query_id", "id", (F.col("seed_score") * w).alias("score"))
    both = hits.select("query_id", "id", "score").unionByName(drawn)
    return both.groupBy("query_id", "id").agg(F.round(F.max("score"), 9).alias("score"))


def wide(near: DataFrame, chunks: DataFrame, k: int = REACH) -> DataFrame:
    """(query_id, id, project, similarity): the k nearest chunks of each query, similarity 1 / (1 + distance)."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "item_id"))
    near = near.withColumn("r", order).where(F.col("r") <= k).drop("r")
    return near.join(chunks.select(F.col("chunk_id").alias("item_id"), "project"), "item_id").select("query_id", F.col("item_id").alias("id"), "project", F.round(1 / (1 + F.col("distance")), 9).alias("similarity"))


def hypothetical(queries: DataFrame, generate, embedder) -> DataFrame:
    """(query_id, vector) of the texts that generate (list[str] -> list[str]) makes of natural-language queries, embedded."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["query_id"], "text": generate(pdf["text"].fillna("").tolist())})

    asked = queries.where(query_class(F.col("text")) == "NaturalLanguage").select("query_id", "text")
    return vectors.embed(asked.mapInPandas(run, "id bigint, text string"), embedder).withColumnRenamed("id", "query_id")


def full(chunks, stored, queries, query_vectors, projects, edges, grade=fusion.overlap_grade, hyde_vectors=None, tier_from: int = fusion.TIER_FROM, tier_keep: int = fusion.TIER_KEEP, k: int = 20, light: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): the whole search over ``latest_chunks`` and ``latest_vectors``.

    Four sources are fused, narrowed to each query's best projects where there are many, expanded
    through the project graph, blended with the vectors of hypothetical documents if there are any
    (query_id, vector), and the pool re-ranked in batches.  Scores are stretched to [0, 1] before they
    are blended with the grades.  light, if it is there, are the chunks without their texts.
    """
    from ..shared import written

    light = chunks if light is None else light
    where = light.select(F.col("chunk_id").alias("id"), "project")
    near = written(vectors.nearest(stored, query_vectors, max(k, REACH), rounded=6), "near")  # the fusion and the expansion look at it
    hits = fused(chunks, stored, queries, query_vectors, k, near, light).join(where, "id").select("query_id", "id", "project", "score")
    hits = written(fusion.tier(hits, projects, tier_from, tier_keep), "hits")  # read by the expansion twice
    found = expand(hits, wide(near, light), edges)
    if hyde_vectors is not None:
        found = fusion.hyde_blend(found, vectors.search(stored, hyde_vectors, k, rounded=6).withColumnRenamed("item_id", "id"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    pool = written(found.withColumn("r", best).where(F.col("r") <= fusion.POOL).drop("r"), "pool")
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    pool = pool.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))
    texts = chunks.select(F.col("chunk_id").alias("id"), "text")
    pairs = pool.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(texts, "id")
    return fusion.graded(pairs.select("query_id", "id", "score", "query", "text"), grade)  # the pool is cut, and texts are not shuffled again


def related_chunks(packed: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, seed, id, rank): up to k chunks beside each packed chunk (query_id, id, file_id, chunk_index) that are not packed themselves.

    The lineage of a chunk is its file: nearest places first, the earlier of two as near.
    """
    other = chunks.select(F.col("chunk_id").alias("id"), F.col("file_id").alias("f"), F.col("chunk_index").alias("c"))
    s = packed.select("query_id", F.col("id").alias("seed"), "file_id", "chunk_index")
    near = s.withColumn("c", F.explode(F.expr(f"transform(filter(sequence(-{k}, {k}), x -> x <> 0), x -> chunk_index + x)"))).join(other.withColumnRenamed("f", "file_id"), ["file_id", "c"])
    near = near.join(packed.select("query_id", "id"), ["query_id", "id"], "left_anti")
    r = F.row_number().over(Window.partitionBy("query_id", "seed").orderBy(F.abs(F.col("c") - F.col("chunk_index")), "c", "id"))
    return near.withColumn("rank", r).where(F.col("rank") <= k).select("query_id", "seed", "id", "rank")


def context(hits: DataFrame, chunks: DataFrame, budget: int = 12_000, k: int = 3) -> DataFrame:
    """(query_id, id, file_id, chunk_index, role, position): dedup, caps, budget, related chunks, order.

    hits are (query_id, id, score, text, file_id, project, chunk_index).  A related chunk stands with
    its seed's score and has the role "related"; of several seeds the best counts.
    """
    from ..shared import written

    keep = ["query_id", "id", "score", "file_id", "chunk_index"]
    chosen = written(packing.within_budget(packing.diverse(packing.dedup(hits)), budget).select(*keep), "chosen")
    more = related_chunks(chosen, chunks, k).join(chosen.select("query_id", F.col("id").alias("seed"), "score"), ["query_id", "seed"]).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    more = more.join(chunks.select(F.col("chunk_id").alias("id"), "file_id", "chunk_index"), "id")
    every = chosen.withColumn("role", F.lit("hit")).unionByName(more.select(*keep).withColumn("role", F.lit("related")))
    return packing.coherent(every).select("query_id", "id", "file_id", "chunk_index", "role", "position")
