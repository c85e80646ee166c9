"""Parities of the Jaccard join, and shuffle files of saved tables."""

import numpy as np
from pyspark.sql import functions as F

from test_jaccard import brute

from vellum.llm import common, jaccard


def lacking(marks, i, j):
    a, b = (np.array(marks[k].as_py(), np.int64) for k in (i, j))
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def test_parities_lose_no_link():
    rng = np.random.default_rng(5)
    kept = 0
    for n in (1, 2, 7, 40, 127, 128, 129, 500, 3000):
        base = np.unique(rng.integers(0, 2**64, 3 * n, np.uint64))
        for _ in range(60):
            a, b = (np.unique(np.concatenate((base[:n], rng.choice(base[n:], rng.integers(0, max(2, n // 3)))))) for _ in range(2))
            cells = jaccard.marks_of([a, b])
            few = (jaccard.NUM + jaccard.DEN) * lacking(cells, 0, 1) <= (jaccard.DEN - jaccard.NUM) * (len(a) + len(b))
            if jaccard.linked(a, b):
                kept += 1
                assert few and jaccard.may_link(jaccard.parities(a), jaccard.parities(b))
        x, y = (np.unique(rng.integers(0, 2**64, n, np.uint64)) for _ in range(2))
        assert not jaccard.may_link(jaccard.parities(x), jaccard.parities(y))
    assert kept > 50


def test_near_copies_that_do_not_link_are_no_rows(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 5000, 150)]

    def edited(k):
        w = list(base)
        for at in rng.choice(150, k, replace=False):
            w[at] = f"e{rng.integers(0, 10**7)}"
        return " ".join(w)

    rows = [(i, edited(4)) for i in range(120)] + [(200 + i, edited(1)) for i in range(5)]
    counts: list = []
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.jaccard_components(df, counts).collect()]
    assert sorted(got) == sorted(brute(rows))
    # without marks more than 7,000 pairs pass the positions of order A
    assert sum(p for p, _, _ in counts) < 2000 and any(n for _, _, n in counts)


def test_saved_tables_leave_no_shuffle_files(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = spark.conf.get(common._CLEANUP)
    seen = tracker.shuffleStatuses().size()
    out = common.saved(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("x")).count())
    assert tracker.shuffleStatuses().size() <= seen
    assert spark.conf.get(common._CLEANUP) == before and out.count() == 7
