import random

import numpy as np
import pytest

from orrery.llm import p10_level as p10
from orrery.shipping import ship

EASY = ["Open the box and look at it.", "The dog is big.", "Put the cup on the mat.", "You can run to the door.", "I see a red ball.", "It is a good day."]
HARD = [
    "Notwithstanding the asymptotic character of the underlying factorization, any sufficiently expressive formulation constitutes an antecedent commitment to materialization.",
    "The proposition that combinatorial linearizability necessitates parameterization is, under permissive regularity assumptions, equivalent to the contention that no representation accommodates reconciliation.",
]
GERMAN = "Der Hund ist nicht im Haus und die Katze ist mit dem Kind auf der Straße. "


def doc(kind, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(EASY if kind == 1 else HARD) for _ in range(n))


def test_prose():
    text = "# Title\n\nSome words here.\n```py\nx = 1\n```\n| a | b |\n|---|---|\n10:02:11 WARN it is full\n\n- see <b>this</b> at https://x.example/a `code` now\n    depth = trim(index);\n"
    assert p10.prose(text.replace("\n", "\r\n")).split() == "Some words here. - see this at now".split()


def test_levels(spark):
    ship(spark)
    rows = [(i, doc(1, 30, i), 7) for i in range(60)] + [(100 + i, doc(4, 6, i), 7) for i in range(60)]
    rows += [(900, None, 7), (901, "", 7), (902, "Too short.", 7), (903, GERMAN * 20, 7), (904, "```\n" + doc(4, 9, 1) + "\n```", 7), (905, doc(4, 2000, 5), 7)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, band int")
    labels = [(i, "a", 1) for i in range(0, 30)] + [(i, "b", 1) for i in range(0, 30)] + [(100 + i, "a", 4) for i in range(30)] + [(31, "a", None), (32, "a", 1), (32, "b", 4), (None, "a", 1), (903, "a", 2), (33, "a", 9)]
    lab = spark.createDataFrame(labels, "doc_id bigint, rater string, band int")
    got = {r.doc_id: r.band for r in p10.levels(d, lab).collect()}
    assert set(got) == {*range(60), *range(100, 160), 905}
    assert all(b == (1 if i < 100 else 4) for i, b in got.items())
    assert p10.levels(d.limit(0), lab).count() == 0
    assert p10.levels(d, lab.limit(0)).count() == 0


def test_coverage_rank_is_the_smallest_vocabulary(spark):
    ship(spark)
    text = " ".join(["the"] * 40 + ["dog"] * 30 + ["is"] * 20 + ["of"] * 9 + ["lattice"] * 1)
    d = spark.createDataFrame([(1, text), (2, "the " * 60)], "doc_id bigint, text string")
    p = p10.profile(d)
    ranked = p10.vocabulary(p)
    assert len(ranked) == 5
    f = {r.doc_id: r for r in p10.features(p, ranked).collect()}
    assert [round(np.exp(f[1][n])) for n in p10.FEATURES[2:]] == [2, 2, 3, 3, 4]
    assert [round(np.exp(f[2][n])) for n in p10.FEATURES[2:]] == [1] * 5


def test_held_out(spark, small):
    """On labelled documents that calibration did not see."""
    ship(spark)
    import os

    d = small.replace("sf0.001", "sf0.1")
    if not os.path.isdir(d):
        pytest.skip("no larger driver tables here")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_labels.parquet")
    f = p10.common.materialize(p10.features(p := p10.common.materialize(p10.profile(docs)), p10.vocabulary(p)))
    rule = p10.calibrate(f, labels.where("doc_id % 2 = 0"))
    held = f.join(p10.truth(labels.where("doc_id % 2 = 1")), "doc_id").withColumn("guess", p10.score(rule))
    n, ok = held.count(), held.where("guess = band").count()
    assert n > 200 and ok / n > 0.9
