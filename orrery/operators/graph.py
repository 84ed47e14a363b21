"""Project graph: edges, expansion, related chunks, feedback and frecency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOP_DECAY, CROSS_BASE, CROSS_SCALE, CROSS_CAP = 0.6, 0.20, 0.70, 0.90
SAME_BASE, SAME_SPAN = 0.76, 0.12


def same_project_weight(similarity):
    return SAME_BASE + SAME_SPAN * similarity


def cross_project_weight(strength):
    return F.least(F.lit(CROSS_CAP), CROSS_BASE + CROSS_SCALE * strength)


def project_edges(shared: DataFrame, k: int = 8) -> DataFrame:
    """(src, dst, strength): per project the k others that share most, from (project, feature) rows.

    strength is the Jaccard share of distinct features.  Features of one project make no pair, and
    pairs are between projects, not between rows: rows collapse to (feature, project) first.
    """
    f = shared.where("project is not null and feature is not null").select("project", "feature").distinct()
    size = f.groupBy("project").agg(F.count("*").alias("n"))
    pair = f.alias("a").join(f.alias("b"), (F.col("a.feature") == F.col("b.feature")) & (F.col("a.project") != F.col("b.project")))
    common = pair.groupBy(F.col("a.project").alias("src"), F.col("b.project").alias("dst")).agg(F.count("*").alias("both"))
    j = common.join(size.select(F.col("project").alias("src"), F.col("n").alias("ns")), "src").join(size.select(F.col("project").alias("dst"), F.col("n").alias("nd")), "dst")
    s = j.select("src", "dst", F.round(F.col("both") / (F.col("ns") + F.col("nd") - F.col("both")), 6).alias("strength"))
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("strength"), "dst"))
    return s.withColumn("r", r).where(F.col("r") <= k).drop("r")


def expand(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, project, weight): projects within two hops of a seed project; the best path counts, a hop costs the decay.

    A path's weight is the product of its edges' cross-project weights, 0.6 per hop; the seed itself has weight 1.
    """
    w = edges.select("src", "dst", (cross_project_weight(F.col("strength")) * HOP_DECAY).alias("w"))
    zero = seeds.select(F.col("project").alias("seed"), "project", F.lit(1.0).alias("weight")).distinct()
    one = zero.join(w, F.col("project") == F.col("src")).select("seed", F.col("dst").alias("project"), (F.col("weight") * F.col("w")).alias("weight"))
    two = one.join(w, F.col("project") == F.col("src")).select("seed", F.col("dst").alias("project"), (F.col("weight") * F.col("w")).alias("weight"))
    every = zero.unionByName(one).unionByName(two)
    return every.groupBy("seed", "project").agg(F.round(F.max("weight"), 9).alias("weight"))


def related(seeds: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """(seed, id, rank): at most k items per seed (id) along edges (src, dst, weight), heaviest first."""
    j = seeds.select(F.col("id").alias("seed")).distinct().join(edges.select(F.col("src").alias("seed"), F.col("dst").alias("id"), "weight"), "seed").where("seed <> id")
    j = j.groupBy("seed", "id").agg(F.max("weight").alias("weight"))
    r = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("weight"), "id"))
    return j.withColumn("rank", r).where(F.col("rank") <= k).drop("weight")


def latest_feedback(log: DataFrame, key: list[str]) -> DataFrame:
    """key with the latest decision and its time; of equal times the greater decision."""
    return log.groupBy(*key).agg(F.max(F.struct("ts", "decision")).alias("m")).select(*key, F.col("m.decision").alias("decision"), F.col("m.ts").alias("ts"))


def without_suppressed(edges: DataFrame, log: DataFrame) -> DataFrame:
    """edges (src, dst, ...) but those whose latest decision is Suppress."""
    gone = latest_feedback(log, ["src", "dst"]).where("decision = 'Suppress'").select("src", "dst")
    return edges.join(gone, ["src", "dst"], "left_anti")


def frecency(events: DataFrame, key: str, now, tau_days: float = 14.0) -> DataFrame:
    """(key, frecency): the sum of exp(-age in days / tau) of events up to now."""
    age = (F.unix_micros((now if isinstance(now, Column) else F.lit(now)).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400e6
    return events.where(F.col(key).isNotNull() & (age >= 0)).groupBy(key).agg(F.round(F.sum(F.exp(-age / tau_days)), 6).alias("frecency"))
