"""What the operators on training data share: reading, partition counts, dedup, files from chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas, shared
from ..functions import text as text_functions

#: Extension -> language of the nine parsed languages.
EXTENSIONS = {e: lang for lang, exts in schemas.EXTENSIONS.items() for e in exts}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def tasks(spark: SparkSession, per_core: int = 3) -> int:
    """How many partitions a CPU-bound Python stage gets: no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """df over enough partitions for a CPU-bound stage: as it is scanned, unless the scan has fewer partitions than there are cores."""
    spark = df.sparkSession
    return df.repartition(tasks(spark, per_core)) if df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else df


def path_of(rel_path: Column, header: Column) -> Column:
    """The path of a chunk: rel_path, else what its context header says."""
    return F.coalesce(rel_path, F.nullif(F.regexp_extract(header, r"(?m)^// File: ([^\n]*)$", 1), F.lit("")))


def language_of(path: Column) -> Column:
    """Language by the last extension, in any case; null for other files and for dot files without one."""
    return F.nullif(text_functions.language_of_path(path), F.lit(""))


def files(chunks: DataFrame, languages: bool = False) -> DataFrame:
    """(file_id, project, path, text): files put together from their chunks.

    Chunks of one chunk_id count once; lines between chunks are blank.  With languages, only
    files whose path has an extension of the nine languages; the path is looked up before
    any text moves.  Rows without file_id are left out; null text counts as empty.  The one
    shuffle is by file_id: a file has to be whole to be judged.
    """
    c = chunks.where(F.col("file_id").isNotNull()).select(
        "file_id", "project", path_of(F.col("rel_path"), F.col("context_header")).alias("path"), "chunk_id", "chunk_index", "line_start", "line_end", F.coalesce("text", F.lit("")).alias("text")
    )
    if languages:
        c = c.where(language_of(F.col("path")).isNotNull())
    n = tasks(chunks.sparkSession)
    item = F.struct(
        F.coalesce("line_start", F.lit(1)).alias("a"), F.coalesce("chunk_index", F.lit(0)).alias("i"), "chunk_id", F.coalesce("line_end", "line_start", F.lit(1)).alias("b"), "text"
    )
    g = (
        c.repartition(n, "file_id")
        .groupBy("file_id")
        .agg(F.min("project").alias("project"), F.min("path").alias("path"), F.array_sort(F.collect_list(item)).alias("all"))
    )
    once = F.expr("filter(all, (x, i) -> i = 0 or x.chunk_id is null or not (all[i - 1].chunk_id <=> x.chunk_id))")
    text = F.expr("array_join(transform(parts, (x, i) -> concat(repeat('\n', greatest(0, x.a - if(i = 0, 1, parts[i - 1].b))), x.text)), '')")
    return g.withColumn("parts", once).select("file_id", "project", "path", text.alias("text"))


def materialize(df: DataFrame) -> DataFrame:
    """df with its lineage cut, written to the session's checkpoint folder (``shared.folder``)."""
    shared.folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    return shared.scratch(spark, name)
