"""Statistics: column functions, rank-based operators and numeric kernels."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from helixframe.runtime import materialize


# --- column functions ----------------------------------------------------------------------------
def ihs(x: Column, theta: float = 1.0) -> Column:
    """Inverse hyperbolic sine, asinh(theta x) / theta; theta 0 is the identity."""
    return x if theta == 0 else F.asinh(F.lit(theta) * x) / F.lit(theta)


def kld(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence in bits of two arrays. Zeros of p are skipped, a zero of q gives infinity."""
    term = lambda x, y: F.when(x == 0, F.lit(0.0)).when(y == 0, F.lit(math.inf)).otherwise(x * (F.log2(x) - F.log2(y)))
    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(p) == F.size(q), total).otherwise(F.raise_error(F.lit("arrays differ in length")).cast("double"))


def jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits."""
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return F.lit(0.5) * kld(p, m) + F.lit(0.5) * kld(q, m)


def gap_penalty(kind: str, x: float) -> Callable[[int, int], float]:
    """Penalty of ``gap`` unmatched columns against ``match`` matched ones: linear, quadratic, cubic or exp."""
    grow = {"linear": lambda g: g, "quadratic": lambda g: g**2, "cubic": lambda g: g**3, "exp": lambda g: 2**g - 1}[kind]
    return lambda gap, match: grow(gap) * x / match


#: Ways to combine the distances of aligned columns.
COMBINE: dict[str, Callable[[np.ndarray], float]] = {
    "l1": lambda v: float(np.mean(v)),
    "l2": lambda v: float(np.sqrt(np.mean(v**2))),
    "l3": lambda v: float(np.cbrt(np.mean(v**3))),
    "max": lambda v: float(np.max(v)),
}


# --- kernels -------------------------------------------------------------------------------------
def hypergeometric_cdf(x: int, m: int, n: int, total: int) -> float:
    """P(X <= x) when n of ``total`` are drawn and m of them are marked; NaN for impossible counts."""
    if not (0 <= m <= total and 0 <= n <= total):
        return math.nan
    lo, hi = max(0, n + m - total), min(n, m)
    if x < lo:
        return 0.0
    if x >= hi:
        return 1.0
    lc = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    base = lc(total, n)
    tail = range(lo, x + 1) if x - lo <= hi - x else range(x + 1, hi + 1)
    s = math.fsum(math.exp(lc(m, k) + lc(total - m, n - k) - base) for k in tail)
    return min(1.0, s if tail.start == lo else max(0.0, 1 - s))


@F.pandas_udf(T.DoubleType())
def hyperquick(x: pd.Series, m: pd.Series, n: pd.Series, total: pd.Series) -> pd.Series:
    """Hypergeometric P(X <= x) per row; equal rows of a batch are computed once."""
    key = pd.DataFrame({"x": x, "m": m, "n": n, "t": total})
    u = key.drop_duplicates()
    known = {tuple(r): math.nan if any(pd.isna(v) for v in r) else hypergeometric_cdf(*map(int, r)) for r in u.itertuples(index=False)}
    return pd.Series([known.get(tuple(r), math.nan) for r in key.itertuples(index=False)])


def lower_bound(values: np.ndarray, q) -> np.ndarray:
    """Index of the first element that is not below the query."""
    return np.searchsorted(values, q, side="left")


def _bandwidth(n: int, sd: float, iqr: float, span: float) -> float:
    """Silverman's rule; data without spread get a share of their span."""
    spread = min((x for x in (sd, iqr / 1.34) if x > 0), default=span)
    return 0.9 * spread * n**-0.2


def _smooth(mesh: np.ndarray, weights: np.ndarray, h: float) -> np.ndarray:
    """Gaussian density at the mesh points of weights that lie on them."""
    k = np.exp(-0.5 * ((mesh[:, None] - mesh[None, :]) / h) ** 2) / (h * math.sqrt(2 * math.pi))
    return k @ weights / weights.sum()


def _mesh(lo: float, hi: float, points: int) -> np.ndarray:
    span = (hi - lo) or 1.0
    return np.linspace(lo - span / 10, hi + span / 10, points)


def gaussian_kde(values: np.ndarray, points: int) -> Callable[[np.ndarray], np.ndarray]:
    """Gaussian kernel density on a mesh, linear between its points and flat beyond its ends.

    The mesh spans the data and a tenth of its range on either side. Values are binned linearly on it
    first, so the cost is points squared at most. Without finite values the density is NaN.
    """
    v = np.asarray(values, dtype=float)
    v = v[np.isfinite(v)]
    if not len(v):
        return lambda x: np.full(np.shape(x), math.nan)
    mesh = _mesh(v.min(), v.max(), points)
    at = (v - mesh[0]) / (mesh[1] - mesh[0])
    i = np.clip(at.astype(int), 0, points - 2)
    w = np.bincount(i, 1 - (at - i), points) + np.bincount(i + 1, at - i, points)
    h = _bandwidth(len(v), v.std(ddof=1) if len(v) > 1 else 0.0, float(np.subtract(*np.percentile(v, [75, 25]))), (v.max() - v.min()) or 1.0)
    density = _smooth(mesh, w, h)
    return lambda x: np.interp(x, mesh, density)


class BitVector:
    """Fixed-size bits, packed eight to a byte."""

    def __init__(self, n: int):
        self.n, self.bits = n, np.zeros((n + 7) // 8, dtype=np.uint8)

    def _at(self, i: int) -> tuple[int, int]:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return i >> 3, 1 << (i & 7)

    def set(self, i: int) -> None:
        b, m = self._at(i)
        self.bits[b] |= m

    def clear(self, i: int) -> None:
        b, m = self._at(i)
        self.bits[b] &= 255 - m

    def __getitem__(self, i: int) -> bool:
        b, m = self._at(i)
        return bool(self.bits[b] & m)

    def __len__(self) -> int:
        return self.n

    def tolist(self) -> list[bool]:
        return np.unpackbits(self.bits, bitorder="little")[: self.n].astype(bool).tolist()


# --- operators -----------------------------------------------------------------------------------
def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank", partition: list[str] = ()) -> DataFrame:
    """Row numbers from 1 in one global order (per ``partition``), without a window over the whole table.

    Rows are range-partitioned and sorted by (``partition``, ``order``) and written with their place in
    their task; the counts of the tasks before (one row per task and group) give the offsets. End
    ``order`` with a unique column for a fixed result.
    """
    keys = [*partition, *order]
    s = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    s = materialize(s, "rank")
    n = s.groupBy(*partition, "__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__lo"))
    w = Window.partitionBy(*partition).orderBy("__p") if partition else Window.orderBy("__p")  # one row a task
    right = n.select(F.col("__p").alias("__q"), *[F.col(c).alias(f"__r{i}") for i, c in enumerate(partition)], (F.sum("__n").over(w) - F.col("__n") - F.col("__lo")).alias("__off"))
    on = F.col("__p") == F.col("__q")
    for i, c in enumerate(partition):
        on = on & F.col(c).eqNullSafe(F.col(f"__r{i}"))
    return s.join(right, on).withColumn(name, F.col("__i") + F.col("__off") + 1).select(*df.columns, name)


def with_neighbours(df: DataFrame, order: list[str], columns: list[str], block: int = 100_000) -> DataFrame:
    """The columns of the rows before and after in a global order, as ``prev_*`` and ``next_*``.

    Rows are ranked, cut into blocks of ``block`` ranks, and the last and first row of a block are lent
    to its neighbours, so that every window holds ``block`` + 2 rows.
    """
    r = global_rank(df, order, "__k").withColumn("__k", F.col("__k") - 1)
    own = F.floor(F.col("__k") / F.lit(block))
    x = r.withColumn("__b", F.explode(F.array_distinct(F.array(F.floor((F.col("__k") - 1) / F.lit(block)), own, F.floor((F.col("__k") + 1) / F.lit(block))))))
    w = Window.partitionBy("__b").orderBy("__k")
    x = x.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns} | {f"next_{c}": F.lead(c).over(w) for c in columns})
    return x.where(F.col("__b") == own).drop("__b")


def density(df: DataFrame, value: str, points: int = 512) -> DataFrame:
    """The Gaussian kernel density of a column at ``points`` mesh points: ``x, density``.

    All finite values are binned linearly on the mesh by one aggregation; only the ``points`` weights and
    five statistics reach the driver. Without finite values there is no row.
    """
    v = F.col(value).cast("double")
    x = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != math.inf))
    n, lo, hi, sd, q = x.agg(F.count("v"), F.min("v"), F.max("v"), F.stddev_samp("v"), F.percentile_approx("v", [0.25, 0.75], F.lit(1_000_000))).first()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "x double, density double")
    mesh = _mesh(lo, hi, points)
    at = (F.col("v") - F.lit(float(mesh[0]))) / F.lit(float(mesh[1] - mesh[0]))
    i = F.least(F.lit(points - 2), F.greatest(F.lit(0), F.floor(at)))
    w = np.zeros(points)
    for r in x.select(i.alias("i"), (at - i).alias("f")).groupBy("i").agg(F.count(F.lit(1)).alias("c"), F.sum("f").alias("f")).collect():
        w[r.i] += r.c - r.f
        w[r.i + 1] += r.f
    d = _smooth(mesh, w, _bandwidth(n, sd or 0.0, q[1] - q[0], (hi - lo) or 1.0))
    return spark.createDataFrame(list(zip(mesh.tolist(), d.tolist(), strict=True)), "x double, density double")


def filter_fdr(df: DataFrame, p: str, alpha: float, tie: str) -> DataFrame:
    """Benjamini-Hochberg: the rows up to the largest rank r (by p, then ``tie``) with p <= r alpha / n, with ``rank``.

    NULL and NaN p-values do not take part.
    """
    x = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    r = materialize(global_rank(x, [p, tie]), "fdr")
    n = r.count()
    top = r.where(F.col(p) <= F.col("rank") * F.lit(float(alpha)) / F.lit(max(1, n))).agg(F.max("rank").alias("m")).scalar()
    return r.where(F.col("rank") <= top)


def slide_average(df: DataFrame, index: str, value: str, k: int, partition: list[str] = ()) -> DataFrame:
    """Mean of the 2k+1 values around each row (fewer at the ends) in the order of ``index``, as ``mean``.

    ``index`` numbers the rows of a partition without gaps. Rows are cut into blocks, and the k rows on
    either side of a block are lent to it, so no window holds a whole partition.
    """
    b = max(10_000, 4 * k)
    i = F.col(index)
    blocks = F.array_distinct(F.filter(F.array(F.floor((i - k) / F.lit(b)), F.floor(i / F.lit(b)), F.floor((i + k) / F.lit(b))), lambda v: v.isNotNull()))
    x = df.withColumn("__b", F.explode(blocks))
    w = Window.partitionBy(*partition, "__b").orderBy(index).rowsBetween(-k, k)
    return x.withColumn("mean", F.avg(value).over(w)).where(F.col("__b") == F.floor(i / F.lit(b))).drop("__b")


def scale(df: DataFrame, value: str, partition: list[str] = ()) -> DataFrame:
    """(x - mean) / sd with unbiased variance per partition, as ``scaled``; NULL where sd is 0 or unknown."""
    keys = [F.col(c).alias(f"__{c}") for c in partition]
    g = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__sd"))
    if partition:
        on = None
        for c in partition:
            e = F.col(c).eqNullSafe(F.col(f"__{c}"))
            on = e if on is None else on & e
        x = df.join(g, on)
        m, sd = F.col("__m"), F.col("__sd")
    else:
        x, m, sd = df, g.select("__m").scalar(), g.select("__sd").scalar()
    return x.withColumn("scaled", F.try_divide(F.col(value) - m, sd)).select(*df.columns, "scaled")


def quantile_normalize(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Long matrix ``row, col, value, normalized``: rank means over the columns; ties get the mean of their rank means.

    The matrix is dense: every column has the same number of rows.
    """
    r = materialize(global_rank(df.select(row, col, value), [value, row], "rank", [col]), "quantile")
    means = r.groupBy(F.col("rank").alias("__k")).agg(F.avg(value).alias("rm"))
    x = r.join(means, F.col("rank") == F.col("__k"))
    tied = x.groupBy(F.col(col).alias("__c"), F.col(value).alias("__v")).agg(F.avg("rm").alias("normalized"))
    return r.join(tied, F.col(col).eqNullSafe(F.col("__c")) & F.col(value).eqNullSafe(F.col("__v"))).select(row, col, value, "normalized")
