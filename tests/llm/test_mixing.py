import random

import pytest

from helixframe.llm import mixing


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randrange(3, 200)
        size = [float(rng.choice([0, 5, 5, rng.randrange(1, 1000)])) for _ in range(n)]
        p = [rng.random()] * n
        q, left = mixing.flight(p, size, rng)
        assert len(left) <= 2 and all(0 <= v <= 1 for v in q)
        assert abs(sum(q) - sum(p)) < 1e-6
        assert abs(sum(a * b for a, b in zip(q, size)) - sum(a * b for a, b in zip(p, size))) < 1e-3


def test_expectation():
    rng = random.Random(2)
    size = [1.0, 7.0, 3.0, 20.0, 2.0]
    n, hits = 4000, [0] * 5
    for _ in range(n):
        q, left = mixing.flight([0.3] * 5, size, rng)
        for i, v in zip(left, mixing.landing([q[i] for i in left], [size[i] for i in left], rng)):
            q[i] = v
        hits = [h + v for h, v in zip(hits, q)]
    assert all(abs(h / n - 0.3) < 0.04 for h in hits)


def test_rates():
    sizes = {"a": (10, 1000), "b": (5, 100), "c": (3, 0)}
    r = mixing.rates(sizes, {"a": (0.5, 1), "b": (0.5, 4), "c": (0.2, 9), "d": (0.1, 1)})
    assert abs(r["a"] * 1000 - r["b"] * 100) < 1e-9 and max(r["a"] / 1, r["b"] / 4) == pytest.approx(1) and set(r) == {"a", "b"}
    assert mixing.rates(sizes, {"b": (1.0, 2)}, 10_000)["b"] == 2
    assert mixing.rates({}, {"a": (1.0, 1)}) == {}


@pytest.mark.parametrize("walk", [20_000, 50])
def test_mix(spark, walk):
    rng = random.Random(4)
    src = lambda: rng.choice(["big"] * 12 + ["mid"] * 4 + ["small", "other", None])
    rows = [(i, src(), rng.choice([None, 0, rng.randrange(1, 300), rng.randrange(1, 300)]), "x") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, copies string").repartition(7)
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 1), ("small", 0.2, 4), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, targets, walk=walk)
    got = m.collect()
    cap = {"big": 1, "mid": 1, "small": 4}
    assert all(1 <= r.copies <= cap[r.source] for r in got) and len({r.doc_id for r in got}) == len(got)
    sh = {r.source: r for r in mixing.shares(m, targets).collect()}
    for s, t in (("big", 4 / 9), ("mid", 3 / 9), ("small", 2 / 9)):
        assert abs(sh[s].actual_share - t) < 0.01
    assert sh["none"].actual_share == 0 and sh["none"].copies == 0
    again = mixing.mix(df.repartition(3), targets, walk=walk).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0
    assert mixing.shares(mixing.mix(df.limit(0), targets), targets).count() == 4


def test_shares_report_what_is_left_out(spark):
    df = spark.createDataFrame([(i, "big", 10) for i in range(400)] + [(400 + i, "few", 10) for i in range(10)] + [(500, "other", 7)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("few", 0.5, 2), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    sh = {r.source: r for r in mixing.shares(mixing.mix(df, targets), targets, df).collect()}
    assert (sh["few"].available_tokens, sh["few"].used_tokens, sh["few"].tokens) == (100, 100, 200)
    assert (sh["big"].available_tokens, sh["big"].used_tokens, sh["big"].used_share) == (4000, 200, 0.05)
    assert (sh["none"].available_documents, sh["none"].used_share) == (0, 0.0)
    total = mixing.available(df, targets).groupBy().sum("available_tokens").collect()[0][0]
    whole = {r.source: r for r in mixing.shares(mixing.mix(df, targets, total_tokens=total), targets, df).collect()}
    assert total == 4100 and whole["big"].tokens == 2050 and whole["few"].tokens == 200 and whole["few"].actual_share < 0.1
