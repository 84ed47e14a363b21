"""Problem 9: sources mixed to target shares by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, sizes

#: Documents per block of a source's prefix sums; a source of more is cut into blocks, so a hot source is never one task.
BLOCK = 50_000


def source_key(source: Column) -> Column:
    """Spellings of one source: case, outer blanks and the marks between words do not matter."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(source)), r"[\s_./-]+", "-"), r"^-+|-+$", ""), F.lit(""))


def plan(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with a target: documents, tokens, share asked, share aimed at, cap and expected copies of a document.

    Sources without documents cannot be met; their shares go to the others in proportion.  The
    total is the largest at which no source exceeds its cap, so every other share is met exactly.
    Repeated targets add up and take the smallest cap; null or non-positive shares and caps below
    one are no targets.
    """
    t = targets.select(source_key(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    t = t.where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    have = docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    p = t.join(have, "source", "left").na.fill(0, ["documents", "tokens"])
    every = Window.partitionBy(F.lit(1))  # as many rows as there are targets
    met = F.when(F.col("tokens") > 0, F.col("target_share"))
    p = p.withColumn("aim", met / F.sum(met).over(every))
    p = p.withColumn("total", F.min(F.col("max_repeats") * F.col("tokens") / F.col("aim")).over(every))
    rate = F.least(F.col("aim") * F.col("total") / F.col("tokens"), F.col("max_repeats").cast("double"))
    return p.withColumn("rate", F.coalesce(rate, F.lit(0.0)))


def mixture(docs: DataFrame, planned: DataFrame, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, n_tokens, copy): each document as often as integer boundaries lie in its stretch of the prefix sum.

    Within a source documents are laid out block by block and by size within a block, each as
    long as its expected copies, from one random offset; so no document exceeds its cap and the
    sizes drawn follow the source's sizes closely.
    """
    rate = planned.where("rate > 0").select("source", "rate", F.ceil(F.col("documents") / block).alias("blocks"))
    d = docs.select("doc_id", "source", "n_tokens").join(rate.drop("rate"), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks"))).drop("blocks")
    per = d.groupBy("source", "block").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("source", "block", F.coalesce("before", F.lit(0)).alias("before"))
    base = before.join(rate.drop("blocks"), "source")
    here = F.row_number().over(Window.partitionBy("source", "block").orderBy("n_tokens", "doc_id"))
    j = d.withColumn("here", here).join(base, ["source", "block"])
    offset = F.pmod(F.xxhash64(F.col("source"), F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    at = F.col("before") + F.col("here")
    copies = F.floor(at * F.col("rate") + offset) - F.floor((at - 1) * F.col("rate") + offset)
    return j.withColumn("copies", copies.cast("int")).where("copies > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, plan) of whole tables; documents of null or untargeted sources are not in the mixture."""
    d = sizes.sized(documents.withColumn("source", source_key(F.col("source"))), ["doc_id", "source"], folder=folder)
    d = common.materialize(d.where("source is not null"))
    p = plan(d, targets)
    return mixture(d, p, seed), p


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """Per targeted source: share asked and reached, tokens, and the most copies of one document against the cap."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("mixed_documents"), F.max("copy").alias("most_copies"))
    j = planned.join(got, "source", "left").na.fill(0, ["mixed_tokens", "mixed_documents", "most_copies"])
    every = Window.partitionBy(F.lit(1))
    return j.select("source", "target_share", "aim", "max_repeats", "documents", "tokens", "mixed_documents", "mixed_tokens", "most_copies", (F.col("mixed_tokens") / F.sum("mixed_tokens").over(every)).alias("share"))
