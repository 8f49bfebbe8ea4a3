"""Contact maps as sparse upper triangles ``i, j, value`` with ``i <= j``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def from_list(cells: DataFrame, seq: str) -> DataFrame:
    """Symmetric sparse cells ``i, j, value``; of cells given twice (in either order) the last by ``seq`` counts."""
    g = cells.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return g.agg(F.max_by("value", seq).alias("value"))


def bin_of(pos: Column, reverse: Column, read_len: Column, resolution: int) -> Column:
    """Bin of a read's 5' end: its start, moved by the read length on the reverse strand."""
    return F.floor(F.when(reverse, pos + read_len).otherwise(pos) / F.lit(resolution))


def contact_map(pairs: DataFrame, *, halve: str = "all") -> DataFrame:
    """Read-pair counts per cell from ``bin1, bin2``: halved everywhere (both mates are listed), or on the diagonal only."""
    g = pairs.groupBy(F.least("bin1", "bin2").alias("i"), F.greatest("bin1", "bin2").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    half = F.floor(F.col("n") / F.lit(2))
    return g.select("i", "j", (half if halve == "all" else F.when(F.col("i") == F.col("j"), half).otherwise(F.col("n"))).alias("value"))


def row_sums(m: DataFrame) -> DataFrame:
    """``i, s``: sums of the full symmetric rows."""
    mirrored = m.select("i", "value").unionByName(m.where("i != j").select(F.col("j").alias("i"), "value"))
    return mirrored.groupBy("i").agg(F.sum("value").cast("double").alias("s"))


def coverage_norm(m: DataFrame, *, root: bool = False) -> DataFrame:
    """value / (s_i s_j), or its square root for ``root``, with s the row sum in millions; a zero product gives 0."""
    s = row_sums(m).withColumn("s", F.col("s") / F.lit(1e6))
    a, b = s.select(F.col("i").alias("__a"), F.col("s").alias("__sa")), s.select(F.col("i").alias("__b"), F.col("s").alias("__sb"))
    x = m.join(a, F.col("i") == F.col("__a")).join(b, F.col("j") == F.col("__b"))
    p = F.col("__sa") * F.col("__sb")
    d = F.sqrt(p) if root else p
    return x.select("i", "j", F.when(p == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("value"), d)).alias("value"))


def expected_by_distance(m: DataFrame, n: int) -> DataFrame:
    """``d, expected``: mean of the diagonal at distance d of an n x n map, absent cells counting 0."""
    g = m.groupBy((F.col("j") - F.col("i")).alias("d")).agg(F.sum("value").alias("s"))
    return g.select("d", (F.col("s") / (F.lit(n) - F.col("d"))).alias("expected"))


def observed_over_expected(m: DataFrame, n: int) -> DataFrame:
    """value / mean of its diagonal; an expected value of 0 gives 0."""
    e = expected_by_distance(m, n)
    x = m.join(e, (F.col("j") - F.col("i")) == F.col("d"))
    return x.select("i", "j", F.coalesce(F.try_divide(F.col("value").cast("double"), F.col("expected")), F.lit(0.0)).alias("value"))


def palette_index(value: Column, lo: float, hi: float, n: int) -> Column:
    """Index of a value in a palette of n colours: 0 up to lo, n - 1 from hi on, else linear."""
    step = F.lit((hi - lo) / n)
    return F.when(value <= lo, 0).when(value >= hi, n - 1).otherwise(((value - lo) / step).cast("int"))
