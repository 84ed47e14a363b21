"""The vector table: versioned buckets of Parquet with a pointer, and its operations."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import DEFAULT_DIM, vector_table


def upsert(old: DataFrame, new: DataFrame, dim: int, order: str | None = None) -> DataFrame:
    """old (chunk_id, vector) with new put in: equal ids replaced, others added.

    A vector of another length raises when its row is computed.  Of repeated ids in new the one
    greatest by order, else by vector, wins.  An empty new is no change.
    """
    last = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc(order or "vector")))
    bad = F.concat(F.lit("vector of chunk "), F.coalesce(F.col("chunk_id").cast("string"), F.lit("null")), F.lit(" has another length than "), F.lit(dim))
    checked = F.when(F.col("vector").isNull() | (F.size("vector") != dim), F.raise_error(bad).cast("array<float>")).otherwise(F.col("vector"))
    n = new.where("chunk_id is not null").withColumn("r_", last).where("r_ = 1").select("chunk_id", checked.alias("vector"))
    return old.select("chunk_id", "vector").join(n.select("chunk_id"), "chunk_id", "left_anti").unionByName(n)


def delete(old: DataFrame, ids: DataFrame) -> DataFrame:
    """old without the chunk_ids of ids."""
    return old.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def rebuild(rows: DataFrame, model: str) -> DataFrame:
    """(chunk_id, vector) of a model's rows (chunk_id, model, dim, vector binary); rows of another length are skipped.

    The length is that of the model's first row by chunk_id, at least 1, and DEFAULT_DIM without any.
    """
    from ..functions.blobs import decode

    own = rows.where(F.col("model") == model)
    dim = own.agg(F.greatest(F.lit(1), F.coalesce(F.min_by("dim", "chunk_id"), F.lit(DEFAULT_DIM)))).scalar()
    return own.select("chunk_id", decode("vector").alias("vector")).where(F.size("vector") == dim)


@dataclass(frozen=True)
class Store:
    """A directory of versions, cut into buckets by a hash of chunk_id.

    A version holds the buckets that it changed; ``pointer-N.json`` tells for every bucket which
    version counts.  A pointer is written beside and renamed, and the highest one counts, so a
    write that fails at any moment leaves the table as it was.
    """

    path: str
    dim: int
    buckets: int = 64

    def _fs(self, spark: SparkSession, name: str = ""):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    def _pointers(self, spark: SparkSession) -> list[int]:
        fs, p = self._fs(spark)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[8:-5]) for n in names if n.startswith("pointer-") and n.endswith(".json"))

    def _read_pointer(self, spark: SparkSession) -> dict | None:
        known = self._pointers(spark)
        if not known:
            return None
        return json.loads("\n".join(r[0] for r in spark.read.text(f"{self.path}/pointer-{known[-1]}.json").collect()))

    def _bucketed(self, df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(n)).cast("int"))

    def _read(self, spark: SparkSession, at: dict, which: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/v{v}/bucket={b}" for b, v in sorted(at["at"].items()) if which is None or int(b) in which]
        return spark.read.schema(vector_table()).parquet(*paths) if paths else spark.createDataFrame([], vector_table())

    def open(self, spark: SparkSession) -> DataFrame:
        """The table; an empty one where there is none.  The dim of an existing table is not checked."""
        at = self._read_pointer(spark)
        return spark.createDataFrame([], vector_table()) if at is None else self._read(spark, at)

    def check_model(self, spark: SparkSession, model: str) -> None:
        """Raises if the table was embedded with another model."""
        at = self._read_pointer(spark)
        if at and at.get("model") not in (None, model):
            raise ValueError(f"the index was embedded with {at['model']}, not {model}: embed again before searching")

    def _commit(self, spark: SparkSession, table: DataFrame, touched: list[int] | None, model: str | None) -> int:
        old = self._read_pointer(spark) or {"version": 0, "at": {}, "buckets": self.buckets}
        version, n = old["version"] + 1, old["buckets"]
        self._bucketed(table, n).repartition(min(n, len(touched) if touched else n), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}")
        fs, p = self._fs(spark, f"v{version}")
        there = {x.getPath().getName()[7:] for x in fs.listStatus(p) if x.getPath().getName().startswith("bucket=")}
        kept = {b: v for b, v in old["at"].items() if touched is not None and int(b) not in touched}
        pointer = {"version": version, "dim": self.dim, "model": model or old.get("model"), "buckets": n, "at": kept | {b: version for b in there}}
        _, new = self._fs(spark, f"_pointer-{version}.tmp")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        if not fs.rename(new, self._fs(spark, f"pointer-{version}.json")[1]):
            raise OSError(f"another writer has made version {version} of {self.path}")
        return version

    def write(self, spark: SparkSession, table: DataFrame, model: str | None = None) -> int:
        return self._commit(spark, table, None, model)

    def _touch(self, spark: SparkSession, ids: DataFrame) -> tuple[list[int], DataFrame]:
        """The buckets of the ids, of which there are no more than the table has, and their rows."""
        at = self._read_pointer(spark) or {"at": {}, "buckets": self.buckets}
        which = [r[0] for r in self._bucketed(ids.where("chunk_id is not null").select("chunk_id"), at["buckets"]).select("bucket").distinct().collect()]
        return which, self._read(spark, at, which)

    def upsert(self, spark: SparkSession, new: DataFrame, order: str | None = None) -> int | None:
        """Rewrites the buckets that new has rows for; the others stay where they are."""
        which, old = self._touch(spark, new)
        return self._commit(spark, upsert(old, new, self.dim, order), which, None) if which else None

    def delete(self, spark: SparkSession, ids: DataFrame) -> int | None:
        which, old = self._touch(spark, ids)
        return self._commit(spark, delete(old, ids), which, None) if which else None

    def count(self, spark: SparkSession) -> int:
        return self.open(spark).count()

    def vacuum(self, spark: SparkSession) -> list[int]:
        """Removes the pointers before the last and the versions that it does not name; gives those versions."""
        at = self._read_pointer(spark)
        if at is None:
            return []
        fs, p = self._fs(spark)
        gone = []
        for x in list(fs.listStatus(p)):
            name = x.getPath().getName()
            if name.startswith("v") and name[1:].isdigit() and int(name[1:]) not in at["at"].values():
                gone.append(int(name[1:]))
                fs.delete(x.getPath(), True)
        for v in self._pointers(spark)[:-1]:
            fs.delete(self._fs(spark, f"pointer-{v}.json")[1], False)
        return sorted(gone)
