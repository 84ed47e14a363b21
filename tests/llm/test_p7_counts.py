from orrery.llm import p7_counts as p7

SCHEMA = "import_id bigint, file_id bigint, import_kind string, raw_specifier string, imported_names array<string>, line_number int, uses int, mark string"


def frame(spark, rows):
    return spark.createDataFrame([(i, f, k, s, None, 1, 9, "clash") for i, f, k, s in rows], SCHEMA)


def test_counts(spark):
    rows = [(1, 1, "Named", " os "), (1, 1, "Named", " os "), (2, 1, "named", "os"), (3, 2, "NAMED", "os\t"), (4, 3, "named", "os"), (5, 4, "module", "os"), (6, 5, None, "os"), (7, 6, "named", "  "), (8, 7, "named", None), (None, 8, "named", "os"), (9, None, "named", "os"), (10, 9, "named", "字" * 10_000)]
    got = {(r.import_kind, r.raw_specifier): (r.uses, r.files, r.mark) for r in p7.counts(frame(spark, rows)).collect()}
    assert got == {("named", "os"): (4, 3, "common"), ("module", "os"): (1, 1, "rare"), ("named", "字" * 10_000): (1, 1, "rare")}
    assert p7.counts(frame(spark, rows).limit(0)).count() == 0


def test_deltas_are_a_recount(spark):
    a = [(i, i % 5, "named", f"m{i % 7}") for i in range(60)]
    b = [(i, (i + (i % 9 == 0)) % 5, "named", f"m{(i + (i % 4 == 0)) % 7}") for i in range(10, 80)]
    old, new = p7.counted(frame(spark, a)), p7.counted(frame(spark, b))
    state = p7.merge(p7.empty_state(spark), p7.deltas(old.limit(0), old))
    change = p7.deltas(old, new)
    moved = p7.merge(state, change)
    assert sorted(map(tuple, p7.frequencies(moved).collect())) == sorted(map(tuple, p7.counts(frame(spark, b)).collect()))
    assert p7.deltas(new, new).count() == 0
    gone = p7.merge(moved, p7.deltas(new, new.limit(0)))
    assert gone.count() == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = p7.Counts(str(tmp_path / "s"), 8)
    rows = p7.counted(frame(spark, [(i, i, "named", f"x{i % 11}") for i in range(200)]))
    none = rows.limit(0)
    first = store.apply(p7.deltas(none, rows))
    assert set(first.values()) == {1} and p7.frequencies(store.load(spark, first)).count() == 11
    old = rows.where("import_id = 7")
    second = store.apply(p7.deltas(old, old.withColumn("raw_specifier", p7.F.lit("new"))), first)
    assert 1 <= sum(v == 2 for v in second.values()) <= 2 and sum(v == 1 for v in second.values()) >= 6
    want = p7.counted(frame(spark, [(i, i, "named", "new" if i == 7 else f"x{i % 11}") for i in range(200)]))
    got = sorted(map(tuple, p7.frequencies(store.load(spark, second)).collect()))
    assert got == sorted(map(tuple, p7.frequencies(p7.merge(p7.empty_state(spark), p7.deltas(none, want))).collect()))
    assert store.apply(p7.deltas(want, want), second) == second
    third = store.apply(p7.deltas(want, none), second)
    assert store.load(spark, third).count() == 0
    assert sorted(map(tuple, p7.frequencies(store.load(spark, first)).collect())) != got  # an earlier version stays readable
