import random

import pytest

from helixframe.operators import periods


def brute(rows):
    out, groups = [], {}
    for k, c, s, e in rows:
        if s is not None and e is not None and e > s:
            groups.setdefault((k, c), []).append((s, e))
    for (k, c), v in groups.items():
        cur = []
        for s, e in sorted(v):
            if cur and s <= cur[-1][1]:
                cur[-1][1] = max(cur[-1][1], e)
            else:
                cur.append([s, e])
        out += [(k, c, "period", s, e) for s, e in cur]
        out += [(k, c, "gap", a[1], b[0]) for a, b in zip(cur, cur[1:])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("share", "leaf"), [(1 / 256, 200_000), (0.05, 50), (0.2, 7)])
def test_against_brute_force(spark, monkeypatch, share, leaf):
    monkeypatch.setattr(periods, "LEAF_ROWS", leaf)
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        k = 1 if rng.random() < 0.5 else rng.randrange(40)
        s = rng.randrange(60_000)
        rows.append((rng.choice([k, k, k, None]), rng.choice(["a", "A", None]), rng.choice([s, s, None]) if rng.random() < 0.1 else s, s + rng.choice([-3, 0, 1, 5, 30, 30, 4000 if rng.random() < 0.02 else 2])))
    rows += rows[:100]
    df = spark.createDataFrame([(*r, 9) for r in rows], "k int, c string, s bigint, e bigint, slab int").repartition(7)
    got = sorted(map(tuple, periods.periods_and_gaps(df, ["k", "c"], "s", "e", slab_share=share).collect()), key=repr)
    assert got == brute(rows)


def test_small_batches_and_extremes(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(1, "a", i, i + (2 if i % 5 else 1)) for i in range(0, 60)] + [(1, "a", -(2**62), -(2**62) + 1), (1, "a", 2**62, 2**62 + 5)]
        df = spark.createDataFrame(rows, "k int, c string, s bigint, e bigint")
        got = sorted(map(tuple, periods.periods_and_gaps(df, ["k", "c"], "s", "e").collect()), key=repr)
        assert got == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    df = spark.createDataFrame([], "k int, c string, s bigint, e bigint")
    assert periods.periods_and_gaps(df, ["k", "c"], "s", "e").count() == 0
    assert periods.periods_and_gaps(spark.createDataFrame([(1, "a", 5, 5)], df.schema), ["k", "c"], "s", "e").count() == 0
