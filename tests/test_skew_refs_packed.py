import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.operators import packed, references as rf, skew


def keys(n=4000, seed=1):
    rng = random.Random(seed)
    return [rng.choice(["a", "b", None]) if rng.random() < 0.6 else f"k{rng.randrange(500)}" for _ in range(n)]


def test_heavy_and_dominant(spark):
    ks = keys()
    df = spark.createDataFrame([(k, i) for i, k in enumerate(ks)], "key string, n int").repartition(5)
    c = Counter(ks)
    assert {r[0] for r in skew.heavy_keys(df, F.col("key"), 0.1).collect()} >= {"a", "b"}
    assert {r[0] for r in skew.dominant_keys(df, "key", 1, 10).collect()} == {k for k, v in c.items() if k and v >= len(ks) / 10}
    got = {r.key: r.n for r in skew.aggregate_by_key(df.select("key"), "key", {"n": (F.count(F.lit(1)), F.sum("n"))}).collect()}
    assert got == dict(c)
    empty = df.limit(0)
    assert skew.dominant_keys(empty, "key", 1, 10).count() == 0 and skew.aggregate_by_key(empty, "key", {"n": (F.count(F.lit(1)), F.sum("n"))}).count() == 0
    with pytest.raises(ValueError):
        skew.heavy_keys(df, F.col("key"), 0)


def test_threshold_is_exact(spark):
    df = spark.createDataFrame([("x",)] * 25 + [("y",)] * 24 + [(f"z{i}",) for i in range(951)], "k string")
    assert [r[0] for r in skew.dominant_keys(df, "k", 25, 1000).collect()] == ["x"]


@pytest.mark.parametrize("most", [0, 1000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join(spark, how, most):
    ks = keys(600)
    left = spark.createDataFrame([(k, i) for i, k in enumerate(ks)], "k string, v int")
    clash = left.withColumn("hk", F.lit("a"))
    assert skew.aggregate_by_key(clash, "k", {"n": (F.count(F.lit(1)), F.sum("n"))}, min_share=0.1).agg(F.sum("n")).first()[0] == 600
    right = spark.createDataFrame([("a", 1), ("a", 2), ("k3", 3), (None, 4)], "k string, v int")
    got = sorted(map(tuple, skew.join_by_key(left, right, "k", how=how, max_broadcast_rows=most, min_share=0.1).collect()), key=repr)
    r = {"a": [1, 2], "k3": [3]}
    want = sorted([(k, i, w) for i, k in enumerate(ks) for w in (r.get(k) or ([None] if how == "left" else []))], key=repr)
    assert got == want


def test_orphans(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    parents = spark.createDataFrame([(1, t("2010-01-01"), None), (1, t("2010-01-01"), None), (2, t("2010-01-01"), t("2012-05-05")), (3, None, None), (None, t("2010-01-01"), None)], "id bigint, c timestamp, x timestamp")
    rows = [("a", i, 1, t("2011-01-01")) for i in range(300)] + [("a", 900, 1, t("2009-01-01")), ("a", 901, 1, t("2010-01-01")), ("b", 1, 2, t("2012-05-05")), ("b", 2, 2, t("2012-05-04")), ("b", 3, 7, t("2000-03-01")), ("b", 4, None, t("2000-03-01")), ("b", 5, 7, None), ("b", 6, 3, t("1990-01-01")), ("b", 7, 1, None)]
    refs = spark.createDataFrame(rows, "table_name string, row_id bigint, ref_id bigint, ref_at timestamp").withColumns({c: F.lit(0) for c in ("hk", "pk", "salt", "born", "ref_kind")})
    got = sorted(map(tuple, rf.orphan_references(refs, rf.parent_validity(parents, "id", "c", "x"), min_share=0.2, salts=5).collect()), key=repr)
    assert got == sorted([("a", 900, 1, "late", "2009-01"), ("b", 1, 2, "deleted", "2012-05"), ("b", 3, 7, "missing", "2000-03"), ("b", 5, 7, "missing", None)], key=repr)
    assert rf.orphan_references(refs.limit(0), rf.parent_validity(parents, "id", "c", "x")).count() == 0


def test_reference_numbers(spark):
    x = ["GO:0012", " obo:GO:7 ", "", "  ", None, "GO:x", "12", "GO:99999999999999999999"]
    df = spark.createDataFrame([(v,) for v in x], "v string")
    assert [r[0] for r in df.select(rf.reference_number(F.col("v"), ":")).collect()] == [12, 7, None, None, None, None, 12, None]


def scalar_values(s):
    out, i, n = [], 0, len(s)
    while i <= n:
        while i < n and s[i] == " ":
            i += 1
        v = None
        if i < n and s[i] == '"':
            j, b = i + 1, ""
            while j < n:
                if s[j] == '"':
                    if s[j + 1 : j + 2] == '"':
                        b, j = b + '"', j + 2
                        continue
                    break
                b, j = b + s[j], j + 1
            if j < n:
                v, i = b, j + 1
        e = i
        while e < n and s[e] not in "|;,\t":
            e += 1
        if v is None:
            v = s[i:e].strip(" ")
        if v:
            out.append(v)
        i = e + 1
    return out


def test_packed_against_scalar(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice('ab"|;,\t \u0001\u0002q0e') for _ in range(rng.randrange(25))) for _ in range(1500)]
    texts += ['"a""b|c" , d', 'x"y|z"', '"open|b', "", None, "   ", '""|a|""', "|".join(['"' + 'q""' * 20_000 + '"', "b" * 100_000])]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, f string")
    got = {r.id: r.v for r in df.select("id", packed.split_packed(F.col("f")).alias("v")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == scalar_values(t or ""), repr(t)


def test_explode_packed(spark):
    df = spark.createDataFrame([(1, "a|b", "x", 0), (2, "c", None, 0), (None, " ,", "p;q", 0)], "id int, f string, g string, pos int")
    got = sorted(map(tuple, packed.explode_packed(df, "id", ["f", "g"], min_values=2).collect()), key=repr)
    assert got == sorted([(1, "f", 1, "a"), (1, "f", 2, "b"), (None, "g", 1, "p"), (None, "g", 2, "q")], key=repr)
    assert packed.explode_packed(df.limit(0), "id", ["f"]).count() == 0


def test_shares_too_small_for_the_sketch(spark, monkeypatch):
    df = spark.range(3000).selectExpr("CASE WHEN id < 40 THEN 0 WHEN id < 60 THEN 1 ELSE id END AS k")
    monkeypatch.setattr(skew, "SKETCH_ITEMS", 100)
    assert {r.hk for r in skew.heavy_keys(df, F.col("k"), 0.005).collect()} == {0, 1}
    assert {r.k for r in skew.dominant_keys(df, "k", 1, 100).collect()} == {0}
