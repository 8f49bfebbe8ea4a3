"""Counting tags over regions, bins and positions.

Regions are identified by ``region_id``; counts come from range joins in which tags have first been
summed per distinct position (or interval), so piles of equal tags are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helixframe.operators.intervals import BED3, five_prime, merge_bed_with, range_join, size


def tag_points(tags: DataFrame, unstranded: str = "error") -> DataFrame:
    """Tags per distinct 5' position as intervals of length one, with ``n``."""
    p = tags.select("chrom", five_prime(unstranded=unstranded).alias("pos")).groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n"))
    return p.select("chrom", F.col("pos").alias("chrom_start"), (F.col("pos") + 1).alias("chrom_end"), "n")


def count_tags(regions: DataFrame, tags: DataFrame) -> DataFrame:
    """``region_id, n``: tags whose 5' end lies in the region, 0 included. Unstranded tags raise."""
    j = range_join(regions.select("region_id", *BED3), tag_points(tags), levels=(None, [0])).groupBy("region_id").agg(F.sum("b_n").alias("n"))
    return regions.select("region_id").join(j, "region_id", "left").select("region_id", F.coalesce("n", F.lit(0)).alias("n"))


def rpkm(regions: DataFrame, tags: DataFrame) -> DataFrame:
    """``region_id, rpkm``: count / (all tags / 1e9) / size; NaN without tags or for a region of size 0."""
    total = tags.agg(F.count(F.lit(1)).alias("t")).scalar()
    x = count_tags(regions, tags).join(regions.select("region_id", size().alias("__len")), "region_id")
    return x.select("region_id", F.coalesce(F.try_divide(F.col("n") * F.lit(1e9), total * F.col("__len")), F.lit(float("nan"))).alias("rpkm"))


def _bin_counts(regions: DataFrame, pairs: DataFrame, k: int, lo: Column, hi: Column, *, points: bool) -> DataFrame:
    """Dense arrays of ``floor(size / k)`` counts per region."""
    nbin = F.floor((F.col("chrom_end") - F.col("chrom_start")) / F.lit(k))
    x = pairs.withColumn("__nb", nbin).where("__nb > 0").withColumn("__hi", F.least(hi, F.col("__nb") - 1)).withColumn("__lo", F.greatest(F.lit(0), F.least(lo, F.col("__hi")) if points else lo)).where("__hi >= __lo")
    c = x.select("region_id", "b_n", F.explode(F.sequence("__lo", "__hi")).alias("i")).groupBy("region_id", "i").agg(F.sum("b_n").alias("n"))
    m = c.groupBy("region_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"))
    y = regions.join(m, "region_id", "left").withColumn("__nb", nbin)
    dense = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("__nb") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint")))
    return y.select("region_id", F.when(F.col("__nb") > 0, dense).otherwise(F.array().cast("array<bigint>")).alias("counts"))


def count_tags_bin(regions: DataFrame, tags: DataFrame, k: int) -> DataFrame:
    """5' ends per bin of ``k`` bases; leftover bases belong to the last bin; a region below ``k`` has no bins."""
    pairs = range_join(regions.select("region_id", *BED3), tag_points(tags), levels=(None, [0]))
    i = F.floor((F.col("b_chrom_start") - F.col("chrom_start")) / F.lit(k))
    return _bin_counts(regions.select("region_id", *BED3), pairs, k, i, i, points=True)


def count_tags_bin_whole(regions: DataFrame, tags: DataFrame, k: int, *, end_exclusive: bool = False) -> DataFrame:
    """Whole tags per bin. A tag that ends on a bin's edge also counts in the next bin, unless
    ``end_exclusive``; one that lies in the leftover bases only counts nowhere."""
    t = tags.groupBy(*BED3).agg(F.count(F.lit(1)).alias("n"))
    pairs = range_join(regions.select("region_id", *BED3), t)
    at = lambda c: F.floor((F.col(c) - F.col("chrom_start") - (1 if end_exclusive and c == "b_chrom_end" else 0)) / F.lit(k))
    return _bin_counts(regions.select("region_id", *BED3), pairs, k, at("b_chrom_start"), at("b_chrom_end"), points=False)


def base_map(tags: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Distinct 5' positions ``chrom, pos`` (unstranded counts as plus); only chroms of ``sizes`` if given."""
    x = tags.select("chrom", five_prime().alias("pos")).distinct()
    return x.join(sizes.select("chrom").distinct(), "chrom", "left_semi") if sizes is not None else x


def query_base_map(regions: DataFrame, bases: DataFrame, sizes: DataFrame) -> DataFrame:
    """``region_id, hits``: one Boolean per base (reversed on the minus strand); NULL for unknown chroms."""
    pts = bases.select("chrom", F.col("pos").alias("chrom_start"), (F.col("pos") + 1).alias("chrom_end"))
    r = regions.select("region_id", *BED3, *(["strand"] if "strand" in regions.columns else [F.lit(None).cast("boolean").alias("strand")]))
    g = range_join(r.select("region_id", *BED3), pts, levels=(None, [0])).groupBy("region_id").agg(F.collect_set("b_chrom_start").alias("on"))
    known = sizes.select(F.col("chrom").alias("__k")).distinct()
    x = r.join(g, "region_id", "left").join(known, F.col("chrom") == F.col("__k"), "left")
    on = F.map_from_arrays(F.coalesce("on", F.array().cast("array<bigint>")), F.transform(F.coalesce("on", F.array().cast("array<bigint>")), lambda v: F.lit(True)))
    hits = F.when(size() > 0, F.transform(F.sequence("chrom_start", F.col("chrom_end") - 1), lambda i: F.map_contains_key(F.col("__m"), i))).otherwise(F.array().cast("array<boolean>"))
    x = x.withColumn("__m", on).withColumn("hits", hits)
    return x.select("region_id", F.when(F.col("__k").isNull(), None).when(F.coalesce("strand", F.lit(True)), F.col("hits")).otherwise(F.reverse("hits")).alias("hits"))


def tag_count_distribution(tags: DataFrame) -> DataFrame:
    """``tags_at_position, n_positions`` for 0..99 (99 and more in the last), over (chrom, strand, 5' position)."""
    at = tags.groupBy("chrom", F.coalesce("strand", F.lit(True)).alias("st"), five_prime().alias("pos")).agg(F.count(F.lit(1)).alias("c"))
    h = at.groupBy(F.least("c", F.lit(99)).alias("c")).agg(F.count(F.lit(1)).alias("n_positions"))
    every = tags.sparkSession.range(100).select(F.col("id").alias("tags_at_position"))
    return every.join(h, F.col("tags_at_position") == F.col("c"), "left").select("tags_at_position", F.coalesce("n_positions", F.lit(0)).alias("n_positions"))


def peak_cluster(peaks: DataFrame, r: int, th: int) -> DataFrame:
    """Merged windows of ``r`` around peak midpoints with at least ``th`` peaks: BED3 and ``score``."""
    mid = F.floor((F.col("chrom_start") + F.col("chrom_end")) / F.lit(2))
    w = peaks.select("chrom", (mid - r).alias("chrom_start"), (mid + r).alias("chrom_end"))
    return merge_bed_with(w, score=F.count(F.lit(1))).where(F.col("score") >= th)


def _closed_overlap() -> Column:
    return F.least("chrom_end", "b_chrom_end") - F.greatest("chrom_start", "b_chrom_start") + 1


def overlap_fragments(regions: DataFrame, tags: DataFrame) -> DataFrame:
    """``region_id, n``: tags per region, both closed intervals."""
    t = tags.groupBy(*BED3).agg(F.count(F.lit(1)).alias("n"))
    g = range_join(regions.select("region_id", *BED3), t, closed=True).groupBy("region_id").agg(F.sum("b_n").alias("n"))
    return regions.select("region_id").join(g, "region_id", "left").select("region_id", F.coalesce("n", F.lit(0)).alias("n"))


def overlap_nucleotides(regions: DataFrame, tags: DataFrame) -> DataFrame:
    """``region_id, n``: overlapped bases per region, closed intervals."""
    t = tags.groupBy(*BED3).agg(F.count(F.lit(1)).alias("n"))
    g = range_join(regions.select("region_id", *BED3), t, closed=True).groupBy("region_id").agg(F.sum(F.col("b_n") * _closed_overlap()).alias("n"))
    return regions.select("region_id").join(g, "region_id", "left").select("region_id", F.coalesce("n", F.lit(0)).alias("n"))


def coverage(regions: DataFrame, tags: DataFrame) -> DataFrame:
    """``region_id, coverage, tag_bases``: overlapped bases (closed) / half-open size, and bases of all tags."""
    total = tags.agg(F.coalesce(F.sum(size() + 1), F.lit(0)).alias("t")).scalar()
    x = overlap_nucleotides(regions, tags).join(regions.select("region_id", size().alias("__len")), "region_id")
    return x.select("region_id", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("__len")), F.lit(float("nan"))).alias("coverage"), total.alias("tag_bases"))


def cross_correlation(tags: DataFrame, shifts: list[int], smooth: int = 4) -> DataFrame:
    """``d, cc``: distinct reverse ends r with a distinct forward start within ``smooth`` of r - d.

    Forward starts and reverse ends (chromEnd) are made distinct, then joined once by range over all
    shifts; unstranded tags raise. Each pair votes for the shifts it fits, and a reverse end counts
    once a shift.
    """
    lo, hi = min(shifts) - smooth, max(shifts) + smooth
    st = F.when(F.col("strand").isNull(), F.raise_error(F.lit("unknown strand")).cast("boolean")).otherwise(F.col("strand"))
    t = tags.withColumn("__st", st)
    fwd = t.where("__st").select("chrom", F.col("chrom_start").alias("f")).distinct()
    rev = t.where("NOT __st").select("chrom", F.col("chrom_end").alias("r")).distinct()
    a = rev.select("r", "chrom", (F.col("r") - hi).alias("chrom_start"), (F.col("r") - lo + 1).alias("chrom_end"))
    b = fwd.select("chrom", F.col("f").alias("chrom_start"), (F.col("f") + 1).alias("chrom_end"))
    j = range_join(a, b, levels=(None, [0])).select("chrom", "r", (F.col("r") - F.col("b_chrom_start")).alias("delta"))
    fits = F.filter(F.array(*[F.lit(d) for d in shifts]), lambda d: F.abs(F.col("delta") - d) <= smooth)
    hit = j.withColumn("d", F.explode(fits)).select("d", "chrom", "r").distinct()
    g = hit.groupBy(F.col("d").alias("__d")).agg(F.count(F.lit(1)).alias("cc"))
    every = tags.sparkSession.createDataFrame([(int(d),) for d in shifts], "d int")
    return every.join(g, F.col("d") == F.col("__d"), "left").select("d", F.coalesce("cc", F.lit(0)).alias("cc"))


def fragment_length(tags: DataFrame, start: int, end: int, step: int = 2, smooth: int = 4) -> DataFrame:
    """The shift with the largest cross-correlation; of equal ones the largest."""
    return cross_correlation(tags, list(range(start, end + 1, step)), smooth).agg(F.max(F.struct("cc", "d")).alias("m")).select(F.col("m.d").alias("fragment_length"))


def interval_scores(regions: DataFrame, graph: DataFrame, *, normalize: bool = False) -> DataFrame:
    """``region_id, score``: sum of value x length over the overlapping records (whole length); / size if ``normalize``."""
    g = range_join(regions.select("region_id", *BED3), graph).groupBy("region_id").agg(F.sum(F.col("b_value") * (F.col("b_chrom_end") - F.col("b_chrom_start"))).alias("s"))
    x = regions.select("region_id", size().alias("__len")).join(g, "region_id", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    return x.select("region_id", (F.try_divide(F.col("s"), F.col("__len")) if normalize else F.col("s")).alias("score"))
