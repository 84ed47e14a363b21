"""Problem 7: how often every distinct value occurs, kept up to date by signed deltas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

STATE = "import_kind string, raw_specifier string, file_id bigint, uses bigint"
RARE_FILES = 3
COMMON_SHARE = 0.05


def counted(imports: DataFrame) -> DataFrame:
    """(import_id, import_kind, raw_specifier, file_id): one row per import_id that counts.

    Kind in lower case, specifier without outer white space; null or blank ones, and rows without
    import_id or file_id, do not count.  Of repeated rows the smallest is taken.
    """
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    r = imports.where(F.col("import_id").isNotNull()).select("import_id", F.struct("file_id", F.lower(trim("import_kind")).alias("k"), trim(F.col("raw_specifier")).alias("s")).alias("r"))
    r = r.groupBy("import_id").agg(F.min("r").alias("r")).select("import_id", F.col("r.k").alias("import_kind"), F.col("r.s").alias("raw_specifier"), "r.file_id")
    return r.where("import_kind <> '' and raw_specifier <> '' and file_id is not null")


_KEY = ["import_id", "import_kind", "raw_specifier", "file_id"]
_TERM = ["import_kind", "raw_specifier", "file_id"]


def deltas(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Signed changes of uses per (kind, specifier, file) from the counted rows that a change took away and brought.

    Only the records of the change are read: a changed record is in both, an unchanged one in neither.
    Equal records cancel before the aggregation by value.
    """
    signed = removed.select(*_KEY, F.lit(-1).cast("bigint").alias("d")).unionByName(added.select(*_KEY, F.lit(1).cast("bigint").alias("d")))
    changed = signed.groupBy(*_KEY).agg(F.sum("d").alias("d")).where("d <> 0")
    return changed.groupBy(*_TERM).agg(F.sum("d").alias("uses")).where("uses <> 0")


def merge(state: DataFrame, change: DataFrame) -> DataFrame:
    """The state after a change: uses per (kind, specifier, file); what falls to zero is gone."""
    return state.unionByName(change).groupBy(*_TERM).agg(F.sum("uses").alias("uses")).where("uses <> 0")


@dataclass(frozen=True)
class Counts:
    """Persistent counts: a folder of buckets by a hash of term and file, of which a change rewrites those it touches.

    A version holds the buckets that it changed; current tells which version of a bucket counts and
    is handed on by the caller, so a merge that fails changes nothing.  A hot term's files are spread
    over all buckets.
    """

    path: str
    buckets: int = 64

    def _put(self, df: DataFrame, version: int, touched: list[int]) -> dict:
        spark = df.sparkSession
        b = F.pmod(F.xxhash64(*_TERM), F.lit(self.buckets)).cast("int")
        tasks = min(self.buckets, max(1, len(touched)), int(spark.conf.get("spark.sql.shuffle.partitions")))
        df.withColumn("bucket", b).repartition(tasks, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}")
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{version}")
        names = [x.getPath().getName() for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
        return {int(n[7:]): version for n in names if n.startswith("bucket=")}

    def load(self, spark: SparkSession, current: dict, only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/v{v}/bucket={b}" for b, v in sorted(current.items()) if only is None or b in only]
        return spark.read.schema(STATE).parquet(*paths) if paths else empty_state(spark)

    def apply(self, change: DataFrame, current: dict | None = None) -> dict:
        """The buckets that count after a change (deltas): those it touches are read, merged and written anew."""
        spark, current = change.sparkSession, current or {}
        version = max(current.values(), default=0) + 1
        if not current:
            return self._put(change.where("uses <> 0"), version, list(range(self.buckets)))
        b = F.pmod(F.xxhash64(*_TERM), F.lit(self.buckets)).cast("int")
        change = common.materialize(change)
        touched = [r[0] for r in change.select(b.alias("b")).distinct().collect()]  # no more than there are buckets
        if not touched:
            return current
        new = self._put(merge(self.load(spark, current, touched), change), version, touched)
        return {k: v for k, v in current.items() if k not in touched} | new


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def frequencies(state: DataFrame) -> DataFrame:
    """Per term: uses, files, share of all files, and the mark rare, common or null.

    A hot term's rows are combined on the map side, first per file in the state and then per term.
    The number of files is a scalar subquery.
    """
    total = state.select("file_id").distinct().agg(F.count("*")).scalar()
    t = state.groupBy("import_kind", "raw_specifier").agg(F.sum("uses").alias("uses"), F.count("*").alias("files"))
    mark = F.when(F.col("files") < RARE_FILES, "rare").when(F.col("files") >= COMMON_SHARE * total, "common")
    return t.select("import_kind", "raw_specifier", "uses", "files", (F.col("files") / total).alias("share"), mark.alias("mark"))


def counts(imports: DataFrame, path: str | None = None) -> DataFrame:
    """``frequencies`` of a whole table by way of the persistent counts: a base load, then the changes since.

    The base holds the table as it was before its last tenth of records came or changed (by a hash of
    import_id): some of these are missing from it, some are there with another specifier, and some
    records are there that are gone now.  The change feed then has them as added, changed and deleted
    records, and merging it must give the counts of the table as it is.
    """
    spark = imports.sparkSession
    rows = common.materialize(counted(imports))
    kind = F.pmod(F.xxhash64("import_id", F.lit(5)), F.lit(30))  # 0 added, 1 changed, 2 deleted since
    was = rows.where(kind == 1).withColumn("raw_specifier", F.concat("raw_specifier", F.lit("~before")))
    gone = rows.where(kind == 2).withColumn("import_id", -F.col("import_id") - 1).withColumn("raw_specifier", F.concat("raw_specifier", F.lit("~gone")))
    store = Counts(path or common.scratch(spark, "counts"))
    none = rows.limit(0)
    current = store.apply(deltas(none, rows.where(kind > 1).unionByName(was).unionByName(gone)))
    current = store.apply(deltas(was.unionByName(gone), rows.where(kind <= 1)), current)
    return frequencies(store.load(spark, current))
