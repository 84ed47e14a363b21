"""The corpus: files under tracked roots, what changed, and the cache of query vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, mtime, size, content) of the files under a root; select path first and filter, then the content is read for those only."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rel = F.regexp_replace("path", "^.*?" + root.rstrip("/").split(":")[-1].replace(".", r"\.") + "/", "")
    return f.select(rel.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def _ancestors(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def without_excluded(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files (project, path, ...) but those at or under an excluded relative directory of roots (project, excludes).

    An equi-join on the directories above a file; no path is compared with every exclude.
    """
    out = roots.select("project", F.explode("excludes").alias("dir")).select("project", F.regexp_replace("dir", "^/+|/+$", "").alias("dir")).where("dir <> ''").distinct()
    hit = files.select("project", "path", F.explode(_ancestors(F.col("path"))).alias("dir")).join(out, ["project", "dir"], "left_semi").select("project", "path").distinct()
    return files.join(hit, ["project", "path"], "left_anti")


def exclude(roots: DataFrame, project: str, directory: str) -> DataFrame:
    return roots.withColumn("excludes", F.when(F.col("project") == project, F.array_union("excludes", F.array(F.lit(directory)))).otherwise(F.col("excludes")))


def include(roots: DataFrame, project: str, directory: str) -> DataFrame:
    return roots.withColumn("excludes", F.when(F.col("project") == project, F.array_except("excludes", F.array(F.lit(directory)))).otherwise(F.col("excludes")))


def add_root(roots: DataFrame, project: str, root: str) -> DataFrame:
    new = roots.sparkSession.createDataFrame([(project, root, [])], "project string, root string, excludes array<string>")
    return roots.select("project", "root", "excludes").unionByName(new).groupBy("project", "root").agg(F.max("excludes").alias("excludes"))


def drop_root(roots: DataFrame, project: str) -> DataFrame:
    return roots.where(F.col("project") != project)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project, path, state) over (project, path, mtime, size, content_hash).

    added, removed, unchanged (same time and size), touched (another time or size, same hash) or
    modified.  Times that are null are compared by the hash.
    """
    o = old.select("project", "path", F.col("mtime").alias("m0"), F.col("size").alias("s0"), F.col("content_hash").alias("h0"), F.lit(True).alias("was"))
    n = new.select("project", "path", "mtime", "size", "content_hash", F.lit(True).alias("is"))
    j = o.join(n, ["project", "path"], "full_outer")
    state = (
        F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed")
        .when((F.col("m0") == F.col("mtime")) & (F.col("s0") == F.col("size")), "unchanged")
        .when(F.col("h0").eqNullSafe(F.col("content_hash")), "touched").otherwise("modified")
    )
    return j.select("project", "path", state.alias("state"))


def latest_files(states: DataFrame) -> DataFrame:
    """One row per file_id, the one seen last."""
    m = states.groupBy("file_id").agg(F.max(F.struct("seen_at", "project", "path", "mtime", "size", "content_hash")).alias("m"))
    return m.select("file_id", "m.*")


def normalized_query(query: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(query), r"\s+", " "))


def cached(cache: DataFrame, now, ttl_seconds: int = 3600, most: int = 4096) -> DataFrame:
    """cache (query, model, last_used, cached_at, ...) within its time to live, the most recently used kept, ties by key.

    The cut is a global top-k, which never sorts the whole cache in one task.
    """
    live = cache.where(F.unix_micros((now if isinstance(now, Column) else F.lit(now)).cast("timestamp")) - F.unix_micros(F.col("cached_at").cast("timestamp")) < ttl_seconds * 1_000_000)
    return live.orderBy(F.desc("last_used"), "query", "model").limit(most)
