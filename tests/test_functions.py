import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as sq, stats


def one(spark, col, **vals):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in vals.items())
    return [r[0] for r in spark.createDataFrame(list(zip(*[v for _, v in vals.values()])), schema).select(col).collect()]


def test_sequence(spark):
    s = ["ACTTCCCGGGD", "", None, "GGNNVB"]
    assert one(spark, sq.reverse_complement(F.col("s")), s=("string", s)) == ["DCCCGGGAAGT", "", None, "BVNNCC"]
    assert one(spark, sq.reverse_complement(F.col("s"), iupac=True), s=("string", ["RYN"])) == ["NRY"]
    assert one(spark, sq.nucleotide_freq(F.col("s")), s=("string", s[:1])) == [{"A": 1, "C": 4, "G": 3, "T": 2}]
    gc = one(spark, sq.gc_content(F.col("s")), s=("string", s))
    assert gc[0] == pytest.approx(7.25 / 11) and math.isnan(gc[1]) and gc[2] is None and gc[3] == pytest.approx((2 + 1 + 1.5) / 6)
    assert one(spark, sq.validated(F.col("s")), s=("string", ["acgt", "acgn", None, ""])) == ["ACGT", None, None, ""]
    assert one(spark, sq.invalid_letter(F.col("s")), s=("string", ["acgn", "a"])) == ["N", None]
    assert one(spark, sq.slice_seq(F.col("s"), 2, 3), s=("string", ["ACGTAC", "AC"])) == ["GTA", ""]
    assert one(spark, sq.poly_a_trimmed(F.col("s"), F.col("s"), 3)[0], s=("string", ["CAAA", "CAA", "AAAA", ""])) == ["C", "CAA", "", ""]
    assert one(spark, sq.quality_scores(F.col("s")), s=("string", ["!I", ""])) == [[0, 40], []]
    assert one(spark, sq.error_probability(F.col("x")), x=("double", [20.0])) == [pytest.approx(0.01)]


def test_quality_summary(spark):
    q = ["!!!", "III", "5!I9"]
    got = {r.cycle: r for r in sq.quality_summary(spark.createDataFrame([(x,) for x in [*q, None]], "qual string")).collect()}
    assert set(got) == {0, 1, 2}
    for c in got:
        v = np.array([ord(x[c]) - 33 for x in q], float)
        assert got[c].mean == pytest.approx(v.mean()) and got[c].m2 == pytest.approx(((v - v.mean()) ** 2).sum()) and got[c]["var"] == pytest.approx(v.var())


def test_divergences(spark):
    a, b = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    kl = one(spark, stats.kld(F.col("a"), F.col("b")), a=("array<double>", [a, b]), b=("array<double>", [b, a]))
    assert kl == [pytest.approx(1.0), math.inf]
    js = one(spark, stats.jsd(F.col("a"), F.col("b")), a=("array<double>", [a, a]), b=("array<double>", [b, a]))
    assert js[0] == pytest.approx(0.5 * (2 * 0.5 * math.log2(0.5 / 0.375)) + 0.5 * (2 * 0.25 * math.log2(0.25 / 0.375) + 0.5)) and js[1] == 0
    assert one(spark, stats.ihs(F.col("x"), 0.5), x=("double", [3.0])) == [pytest.approx(math.log(1.5 + math.sqrt(3.25)) / 0.5)]
    with pytest.raises(Exception, match="differ in length"):
        one(spark, stats.kld(F.col("a"), F.col("b")), a=("array<double>", [a]), b=("array<double>", [[1.0]]))


def test_kernels(spark):
    def exact(x, m, n, t):
        return sum(math.comb(m, k) * math.comb(t - m, n - k) for k in range(0, x + 1) if n - k >= 0) / math.comb(t, n)

    for x, m, n, t in [(3, 10, 12, 50), (0, 5, 5, 20), (7, 10, 8, 30), (40, 100, 90, 400)]:
        assert stats.hypergeometric_cdf(x, m, n, t) == pytest.approx(exact(x, m, n, t), rel=1e-9)
    assert stats.hypergeometric_cdf(-1, 3, 3, 9) == 0 and stats.hypergeometric_cdf(3, 3, 3, 9) == 1 and math.isnan(stats.hypergeometric_cdf(1, 30, 3, 9))
    assert stats.lower_bound(np.array([1, 3, 3, 7]), [0, 3, 4, 9]).tolist() == [0, 1, 3, 4]
    rng = np.random.default_rng(1)
    d = stats.gaussian_kde(rng.normal(size=5000), 256)
    x = np.linspace(-4, 4, 500)
    assert np.trapezoid(d(x), x) == pytest.approx(1, abs=0.02) and d(np.array([0.0]))[0] == pytest.approx(0.4, abs=0.04)
    assert np.isfinite(stats.gaussian_kde(np.array([2.0, 2.0]), 16)(np.array([2.0]))).all() and math.isnan(stats.gaussian_kde(np.array([]), 8)(0.0))
    b = stats.BitVector(11)
    b.set(3), b.set(10), b.clear(3)
    assert b[10] and not b[3] and b.tolist() == [False] * 10 + [True] and len(b) == 11
    with pytest.raises(IndexError):
        b.set(11)
    assert stats.gap_penalty("cubic", 0.1)(2, 4) == pytest.approx(0.2) and stats.COMBINE["l2"](np.array([3.0, 4.0])) == pytest.approx(math.sqrt(12.5))


def test_density(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=3000)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (math.nan,), (math.inf,)], "v double").repartition(5)
    got = sorted((r.x, r.density) for r in stats.density(df, "v", 128).collect())
    want = stats.gaussian_kde(v, 128)
    assert [d for _, d in got] == pytest.approx(want(np.array([x for x, _ in got])).tolist(), rel=0.01, abs=1e-4)
    assert stats.density(df.limit(0), "v").count() == 0


def long_matrix(spark, m):
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "r int, c int, v double")


def test_quantile_normalization(spark):
    x1 = [[2, 4, 4, 5], [5, 14, 4, 7], [4, 8, 6, 9], [3, 8, 5, 8], [3, 9, 3, 5]]
    y1 = [[3.5, 3.5, 5.25, 4.25], [8.5, 8.5, 5.25, 5.5], [6.5, 5.25, 8.5, 8.5], [5.25, 5.25, 6.5, 6.5], [5.25, 6.5, 3.5, 4.25]]
    got = {(r.r, r.c): r.normalized for r in stats.quantile_normalize(long_matrix(spark, x1), "r", "c", "v").collect()}
    assert got == {(i, j): pytest.approx(y1[i][j]) for i in range(5) for j in range(4)}
    x2, y2 = [[5, 4, 3], [2, 1, 4], [3, 4, 6], [4, 2, 8]], [[5.67, 5.17, 2], [2, 2, 3], [3, 5.17, 4.67], [4.67, 3, 5.67]]
    got = {(r.r, r.c): round(r.normalized, 2) for r in stats.quantile_normalize(long_matrix(spark, x2), "r", "c", "v").collect()}
    assert got == {(i, j): pytest.approx(y2[i][j]) for i in range(4) for j in range(3)}


def test_ranks_fdr_windows(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0.1, 0.2, rng.random()]), "ab"[i % 2]) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, p double, g string").repartition(6)
    got = {r.i: r["rank"] for r in stats.global_rank(df, ["p", "i"]).collect()}
    assert got == {x[0]: k + 1 for k, x in enumerate(sorted(rows, key=lambda x: (x[1], x[0])))}
    by = {r.i: r["rank"] for r in stats.global_rank(df, ["p", "i"], partition=["g"]).collect()}
    for g in "ab":
        assert {x[0]: by[x[0]] for x in rows if x[2] == g} == {x[0]: k + 1 for k, x in enumerate(sorted((x for x in rows if x[2] == g), key=lambda x: (x[1], x[0])))}
    nb = {r.i: (r.prev_i, r.next_i) for r in stats.with_neighbours(df, ["p", "i"], ["i"], block=7).collect()}
    s = [x[0] for x in sorted(rows, key=lambda x: (x[1], x[0]))]
    assert nb == {v: (s[k - 1] if k else None, s[k + 1] if k + 1 < len(s) else None) for k, v in enumerate(s)}
    for alpha in (0.05, 0.6, 1.0):
        s = sorted(rows, key=lambda x: (x[1], x[0]))
        top = max((k for k, x in enumerate(s, 1) if x[1] <= k * alpha / len(s)), default=0)
        assert {r.i for r in stats.filter_fdr(df, "p", alpha, "i").collect()} == {x[0] for x in s[:top]}
    assert stats.filter_fdr(df.limit(0), "p", 0.1, "i").count() == 0
    n = 25_000
    big = spark.range(n).select(F.col("id").alias("i"), (F.col("id") * 7919 % 1000).cast("double").alias("v"))
    m = {r.i: r["mean"] for r in stats.slide_average(big, "i", "v", 2).collect()}
    v = [i * 7919 % 1000 for i in range(n)]
    assert len(m) == n and all(m[i] == pytest.approx(np.mean(v[max(0, i - 2) : i + 3])) for i in [0, 1, 2, 9998, 9999, 10000, 10001, n - 2, n - 1])
    sc = stats.scale(df, "p", ["g"]).groupBy("g").agg(F.avg("scaled").alias("m"), F.stddev_samp("scaled").alias("s")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 for r in sc)
    assert all(r.scaled is None for r in stats.scale(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x").collect())


def test_quality_sums_cover_all_symbols(spark, tmp_path):
    from helixframe.plans import genomics

    spark.createDataFrame([(1, "!+5 é"), (2, ""), (3, "I" * 10)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.score_sum, r.error_sum) for r in genomics.QUERIES["f5_quality_sums"](spark, str(tmp_path)).collect()}
    assert got == {1: (3, 30, 1.11), 3: (10, 400, 0.001)}
