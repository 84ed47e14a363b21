from datetime import datetime, timedelta

from pyspark.sql import functions as F

from orrery.shipping import ship
from orrery.sources import corpus, store
from orrery.streaming import watch


def test_scan_and_excludes(spark, tmp_path):
    for p in ("a/x.py", "a/skip/y.py", "b/z.md", "skipper/k.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    f = corpus.scan(spark, str(tmp_path)).withColumn("project", F.lit("p"))
    assert {r.path for r in f.collect()} == {"a/x.py", "a/skip/y.py", "b/z.md", "skipper/k.py"}
    roots = spark.createDataFrame([("p", "/r", ["a/skip", "skip/", ""])], "project string, root string, excludes array<string>")
    assert {r.path for r in corpus.without_excluded(f, roots).collect()} == {"a/x.py", "b/z.md", "skipper/k.py"}
    roots = corpus.exclude(corpus.include(roots, "p", "a/skip"), "p", "b")
    assert {r.path for r in corpus.without_excluded(f, roots).collect()} == {"a/x.py", "a/skip/y.py", "skipper/k.py"}
    assert corpus.add_root(roots, "q", "/s").count() == 2 and corpus.drop_root(roots, "p").count() == 0


def test_changes(spark):
    t = datetime(2024, 1, 1)
    schema = "project string, path string, mtime timestamp, size bigint, content_hash string"
    old = spark.createDataFrame([("p", "same", t, 1, "a"), ("p", "touched", t, 1, "a"), ("p", "changed", t, 1, "a"), ("p", "gone", t, 1, "a"), ("p", "untimed", None, 1, "a")], schema)
    later = t + timedelta(1)
    new = spark.createDataFrame([("p", "same", t, 1, "z"), ("p", "touched", later, 1, "a"), ("p", "changed", later, 2, "b"), ("p", "new", t, 1, "a"), ("p", "untimed", None, 1, "a")], schema)
    assert {r.path: r.state for r in corpus.changes(old, new).collect()} == {"same": "unchanged", "touched": "touched", "changed": "modified", "gone": "removed", "new": "added", "untimed": "touched"}
    assert corpus.changes(old.limit(0), new.limit(0)).count() == 0


def test_cache(spark):
    now = datetime(2024, 1, 1, 12)
    rows = [(f"q{i}", "m", now - timedelta(minutes=i), now - timedelta(minutes=10 * i)) for i in range(8)]
    c = spark.createDataFrame(rows, "query string, model string, last_used timestamp, cached_at timestamp")
    assert [r.query for r in corpus.cached(c, now, 3600, 4).collect()] == ["q0", "q1", "q2", "q3"]
    assert {r.query for r in corpus.cached(c, now).collect()} == {f"q{i}" for i in range(6)}
    assert spark.createDataFrame([("  A \n b ",)], "q string").select(corpus.normalized_query(F.col("q"))).first()[0] == "a b"


def test_stream_is_the_batch(spark, tmp_path):
    ship(spark)
    rows = [(i % 7, [float(i)], i) for i in range(40)]
    schema = "chunk_id bigint, vector array<float>, stored_at int"
    for k in range(4):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    files = [str(p) for p in sorted((tmp_path / "in").rglob("*.parquet"))]
    flat = tmp_path / "flat"
    flat.mkdir()
    for k, p in enumerate(files):  # file times order the micro-batches
        (flat / f"{k}.parquet").write_bytes(open(p, "rb").read())
        import os

        os.utime(flat / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    s = store.Store(str(tmp_path / "store"), 1)
    watch.upsert_stream(watch.source(spark, str(flat), schema, 1), s, str(tmp_path / "check")).awaitTermination()
    whole = store.upsert(s.open(spark).limit(0), spark.createDataFrame(rows, schema), 1, "stored_at")
    assert sorted(map(tuple, s.open(spark).collect())) == sorted(map(tuple, whole.collect()))


def test_fresh_entries(spark, tmp_path):
    t = datetime(2024, 1, 1)
    spark.createDataFrame([("q", "m", t), ("q", "m", t + timedelta(minutes=5)), ("r", "m", t)], "query string, model string, cached_at timestamp").write.parquet(str(tmp_path / "in"))
    q = watch.fresh(watch.source(spark, str(tmp_path / "in"), "query string, model string, cached_at timestamp")).writeStream.format("memory").queryName("fresh_entries").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.query for r in spark.table("fresh_entries").collect()) == ["q", "r"]
