"""Interval algebra over any DataFrame with ``chrom, chrom_start, chrom_end`` (0-based, half-open).

Range joins are equi-joins on (chrom, level, bin). An interval belongs to the finest level whose bins
are at least as long as it is, so at its own and every coarser level it lies in two bins at most,
however long it is; a pair meets at the coarser of its two levels only, in its first common bin. No
candidate is ever emitted twice, and short intervals never meet in coarse bins. Bins of the coarsest
levels hold whole chroms, so they are salted: the longer interval of a pair goes to every salt, the
shorter one to its own. Which levels occur is a subquery over the borders, so both sides are joined in
one scan each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from helixframe.operators.periods import periods_and_gaps
from helixframe.runtime import materialize

#: Bins of the levels are powers of two wide, by steps of 8 from 2**14; the last holds everything.
SHIFTS = [14, 17, 20, 23, 26, 29, 62]
#: Salts of a bin of each level.
SALTS = [1, 1, 1, 1, 8, 64, 64]

BED3 = ["chrom", "chrom_start", "chrom_end"]


# --- columns -------------------------------------------------------------------------------------
def size(s: Column | str = "chrom_start", e: Column | str = "chrom_end") -> Column:
    """End minus start."""
    return F.col(e) - F.col(s) if isinstance(s, str) else e - s


def is_overlapped(c1: Column, s1: Column, e1: Column, c2: Column, s2: Column, e2: Column) -> Column:
    """Same chrom and a shared base; touching intervals share none."""
    return (c1 == c2) & (e1 > s2) & (e2 > s1)


def size_overlapped(c1: Column, s1: Column, e1: Column, c2: Column, s2: Column, e2: Column) -> Column:
    """Shared bases, 0 across chroms."""
    return F.when(c1 == c2, F.greatest(F.lit(0), F.least(e1 - s2, e2 - s1, e1 - s1, e2 - s2))).otherwise(F.lit(0))


def five_prime(strand: str = "strand", unstranded: str = "plus") -> Column:
    """5' position of a tag. Unstranded tags count as plus, raise (``unstranded='error'``), or give NULL."""
    other = {"plus": F.col("chrom_start"), "error": F.raise_error(F.lit("unknown strand")).cast("bigint"), "null": F.lit(None).cast("bigint")}[unstranded]
    return F.when(F.col(strand), F.col("chrom_start")).when(~F.col(strand), F.col("chrom_end") - 1).otherwise(other)


def sort_bed(df: DataFrame) -> DataFrame:
    """By chrom in byte order, start, end (range-partitioned)."""
    return df.orderBy(*BED3)


def as_bed(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Project to BED6: missing name, score and strand become NULL; ``extra`` columns are kept."""
    opt = {"name": "string", "score": "int", "strand": "boolean"}
    return df.select(*BED3, *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in opt.items()], *extra)


def clip_bed(df: DataFrame, sizes: DataFrame, *, keep_inverted: bool = False) -> DataFrame:
    """Cut intervals to ``[0, size)`` of their chrom (``sizes``: ``chrom, size``, one row each).

    Unknown chroms and starts at or beyond the size are dropped, and (unless ``keep_inverted``) what is
    left of 0. A chrom given twice in ``sizes`` raises. The join side is left to the planner, which
    broadcasts it only by its measured size.
    """
    one = sizes.groupBy(F.col("chrom").alias("__c")).agg(F.count(F.lit(1)).alias("__n"), F.max("size").alias("__sz"))
    one = one.withColumn("__sz", F.when(F.col("__n") > 1, F.raise_error(F.lit("a chrom has two sizes")).cast("bigint")).otherwise(F.col("__sz")))
    x = df.join(one, F.col("chrom") == F.col("__c")).where("chrom_start < __sz")
    x = x.withColumn("chrom_end", F.least("chrom_end", "__sz")).withColumn("chrom_start", F.greatest("chrom_start", F.lit(0)))
    return (x if keep_inverted else x.where("chrom_end > chrom_start")).drop("__c", "__n", "__sz")


# --- range joins ---------------------------------------------------------------------------------
def _level(s: Column, e: Column) -> Column:
    c = F.lit(len(SHIFTS) - 1)
    for i in reversed(range(len(SHIFTS) - 1)):
        c = F.when(e - s <= 1 << SHIFTS[i], F.lit(i)).otherwise(c)
    return c


def _levels(df: DataFrame, c: str) -> Column:
    """Levels that occur (at most ``len(SHIFTS)`` numbers), as an array made by a subquery."""
    return F.coalesce(df.agg(F.collect_set(c).alias("l")).scalar(), F.array().cast("array<int>"))


def _bins(df: DataFrame, p: str) -> DataFrame:
    """One row per bin for each entry (level, role, spread) of the array ``__at``; ``spread`` fills all salts."""
    pick = lambda v: F.element_at(F.array(*[F.lit(i) for i in v]), F.col("__e.l") + 1)
    x = df.withColumn("__e", F.explode("__at"))
    lo, hi = (F.call_function("shiftright", F.col(f"__{p}{c}"), pick(SHIFTS)) for c in "sz")
    salts = pick(SALTS)
    own = F.pmod(F.xxhash64(f"__{p}s", f"__{p}z"), salts)
    x = x.withColumn(f"__{p}f", lo).withColumn(f"__{p}b", F.explode(F.sequence(lo, hi)))
    x = x.withColumn(f"__{p}h", F.explode(F.when(F.col("__e.s"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(own.cast("int")))))
    return x.withColumn(f"__{p}k", F.col("__e.l") * 2 + F.col("__e.r")).drop("__e", "__at", f"__{p}v")


def range_join(a: DataFrame, b: DataFrame, *, within: bool = False, containing: bool = False, closed: bool = False, prefix: str = "b_", levels: tuple[list[int] | None, list[int] | None] = (None, None)) -> DataFrame:
    """Pairs of intervals that overlap: all columns of ``a``, and those of ``b`` with ``prefix``.

    ``within``: b lies inside a; ``containing``: a lies inside b. ``closed``: ends are inclusive, so
    touching counts. Half-open intervals of size 0 or less overlap nothing; NULL chroms and borders match
    nothing. ``levels``: the levels of a and b where they are known (points have level 0), else they are
    looked up by a subquery.
    """

    def prep(d, p):
        s, z = F.col("chrom_start").cast("bigint"), F.col("chrom_end").cast("bigint") - (0 if closed else 1)
        return d.withColumns({f"__{p}s": s, f"__{p}z": z}).where(f"__{p}z >= __{p}s").withColumn(f"__{p}v", _level(F.col(f"__{p}s"), F.col(f"__{p}z") + 1))

    x = prep(a, "a")
    y = prep(b.select(*[F.col(c).alias(f"{prefix}{c}") for c in b.columns], "chrom_start", "chrom_end"), "b").drop("chrom_start", "chrom_end")
    la, lb = (_levels(d, c) if v is None else F.array(*[F.lit(i) for i in v]).cast("array<int>") for d, c, v in ((x, "__av", levels[0]), (y, "__bv", levels[1])))
    entry = lambda lv, role, spread: F.struct(lv.alias("l"), F.lit(role).alias("r"), F.lit(spread).alias("s"))
    # Role 0: a is the longer one, or as long; role 1: b is. The longer one comes at its own level.
    x = x.withColumn("__lv", lb)
    x = x.withColumn("__at", F.concat(F.array(entry(F.col("__av"), 0, True)), F.transform(F.filter("__lv", lambda i: i > F.col("__av")), lambda i: entry(i, 1, False)))).drop("__lv")
    y = y.withColumn("__lv", la)
    y = y.withColumn("__at", F.concat(F.transform(F.filter("__lv", lambda i: i >= F.col("__bv")), lambda i: entry(i, 0, False)), F.when(F.exists("__lv", lambda i: i < F.col("__bv")), F.array(entry(F.col("__bv"), 1, True))).otherwise(F.array().cast("array<struct<l:int,r:int,s:boolean>>")))).drop("__lv")
    c = {k: F.col(f"__{k}") for k in ("as", "az", "bs", "bz", "ak", "bk", "ab", "bb", "ah", "bh", "af", "bf")}
    test = (c["bs"] <= c["az"]) & (c["as"] <= c["bz"])
    if within:
        test = (c["bs"] >= c["as"]) & (c["bz"] <= c["az"])
    if containing:
        test = (c["as"] >= c["bs"]) & (c["az"] <= c["bz"])
    on = (F.col("chrom") == F.col(f"{prefix}chrom")) & (c["ak"] == c["bk"]) & (c["ab"] == c["bb"]) & (c["ah"] == c["bh"])
    j = _bins(x, "a").join(_bins(y, "b"), on & test & (c["ab"] == F.greatest("__af", "__bf")))
    return j.select(*a.columns, *[f"{prefix}{c}" for c in b.columns])


def build_side(df: DataFrame, **aggs: Column) -> DataFrame:
    """Rows with equal ``chrom, chrom_start, chrom_end`` combined by ``aggs`` (none: one row per key)."""
    g = df.groupBy(*BED3)
    return g.agg(*[c.alias(n) for n, c in aggs.items()]) if aggs else df.select(*BED3).distinct()


def query_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join of the rows of ``a`` with the distinct intervals of ``b`` they overlap."""
    return range_join(a, build_side(b))


def _islands(b: DataFrame) -> DataFrame:
    """Periods and the gaps between them, written: ``chrom, span_kind, span_start, span_end``."""
    return materialize(periods_and_gaps(b, ["chrom"], "chrom_start", "chrom_end"), "islands")


def _hits(a: DataFrame, islands: DataFrame) -> DataFrame:
    """Rows of ``a`` with a partner, each once: of the periods a row overlaps only the first has its predecessor's end at or before the row."""
    gap = islands.where("span_kind = 'gap'").select(F.col("chrom").alias("gc"), F.col("span_end").alias("ge"), F.col("span_start").alias("before"))
    p = islands.where("span_kind = 'period'").join(gap, (F.col("chrom") == F.col("gc")) & (F.col("span_start") == F.col("ge")), "left")
    p = p.select("chrom", F.col("span_start").alias("chrom_start"), F.col("span_end").alias("chrom_end"), "before")
    return range_join(a, p, prefix="__i_").where("__i_before IS NULL OR __i_before <= chrom_start").select(*a.columns)


def _misses(a: DataFrame, islands: DataFrame) -> DataFrame:
    """Rows of ``a`` without a partner: those beyond the first and last period of their chrom or of no size, and those inside one gap."""
    ends = islands.where("span_kind = 'period'").groupBy(F.col("chrom").alias("__c")).agg(F.min("span_start").alias("__lo"), F.max("span_end").alias("__hi"))
    at = a.join(ends, F.col("chrom") == F.col("__c"), "left")
    away = F.col("__c").isNull() | F.coalesce((F.col("chrom_end") <= F.col("chrom_start")) | (F.col("chrom_end") <= F.col("__lo")) | (F.col("chrom_start") >= F.col("__hi")), F.lit(True))
    gaps = islands.where("span_kind = 'gap'").select("chrom", F.col("span_start").alias("chrom_start"), F.col("span_end").alias("chrom_end"))
    inside = range_join(at.where(~away).select(*a.columns), gaps, containing=True, prefix="__i_")
    return at.where(away).select(*a.columns).unionByName(inside.select(*a.columns))


def intersect_bed(a: DataFrame, b: DataFrame, *, negate: bool = False) -> DataFrame:
    """Rows of ``a`` that overlap any of ``b`` (``negate``: that overlap none), repeats kept.

    ``b`` is merged first: one period per stretch, so a pile of intervals costs one candidate. Whether a
    row comes out follows from its own borders, so rows need no numbers, and a side that is read in
    another order the second time makes no difference.
    """
    return (_misses if negate else _hits)(a, _islands(b))


def intersect_bed_with(a: DataFrame, b: DataFrame, name: str = "overlaps") -> DataFrame:
    """Every row of ``a`` with the sorted array of the intervals of ``b`` it overlaps (empty if none).

    The array holds structs of the columns of ``b``, ordered by start and end. Its length is the
    result asked for; use :func:`query_intersect` where one row per pair is enough. The rows of ``a`` are
    numbered and written once, so that both places that read them see the same numbers.
    """
    x = materialize(a.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    cols = ["chrom_start", "chrom_end", *[c for c in b.columns if c not in ("chrom_start", "chrom_end")]]
    pairs = range_join(x.select("__id", *BED3), b, prefix="__b_")
    g = pairs.groupBy(F.col("__id").alias("__g")).agg(F.sort_array(F.collect_list(F.struct(*[F.col(f"__b_{c}").alias(c) for c in cols]))).alias("__o"))
    none = F.array().cast(g.schema["__o"].dataType)
    return x.join(g, F.col("__id") == F.col("__g"), "left").select(*a.columns, F.coalesce("__o", none).alias(name))


# --- merging and depth ---------------------------------------------------------------------------
def merge_bed(df: DataFrame) -> DataFrame:
    """Union of the intervals per chrom; touching ones merge (see :mod:`helixframe.operators.periods`)."""
    p = periods_and_gaps(df, ["chrom"], "chrom_start", "chrom_end", with_gaps=False)
    return p.select("chrom", F.col("span_start").alias("chrom_start"), F.col("span_end").alias("chrom_end"))


def merge_bed_with(df: DataFrame, **aggs: Column) -> DataFrame:
    """Merged intervals with ``aggs`` over their members (columns of ``df``).

    Periods are found first and joined back by range, so members of a large chrom need no ordered
    window over the chrom; each member lies in exactly one period.
    """
    periods = materialize(merge_bed(df), "merged")
    pairs = range_join(df, periods, prefix="m_")
    g = pairs.groupBy("m_chrom", "m_chrom_start", "m_chrom_end").agg(*[c.alias(n) for n, c in aggs.items()])
    return g.select(F.col("m_chrom").alias("chrom"), F.col("m_chrom_start").alias("chrom_start"), F.col("m_chrom_end").alias("chrom_end"), *aggs)


def depth_segments(df: DataFrame) -> DataFrame:
    """Stretches of equal depth: ``chrom, chrom_start, chrom_end, depth`` (depth 0 is not listed).

    Starts add one, ends take one off; events are summed per position, range-partitioned and summed up
    within their part. The depth at the start of a part, and the first position of the next, come from a
    table with one row per part and chrom, so no window spans a chrom, however dense its coverage.
    """
    x = df.where("chrom_end > chrom_start AND chrom IS NOT NULL")
    ends = F.explode(F.array(F.struct(F.col("chrom_start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("chrom_end").alias("pos"), F.lit(-1).alias("d"))))
    ev = x.select("chrom", ends.alias("e")).groupBy("chrom", "e.pos").agg(F.sum("e.d").alias("d"))
    s = materialize(ev.repartitionByRange("chrom", "pos").withColumn("part", F.spark_partition_id()), "events")
    over = Window.partitionBy("chrom").orderBy("part")  # one row a part
    parts = s.groupBy("chrom", "part").agg(F.sum("d").alias("t"), F.min("pos").alias("lo"))
    parts = parts.select(F.col("chrom").alias("pc"), F.col("part").alias("pp"), (F.sum("t").over(over) - F.col("t")).alias("entry"), F.lead("lo").over(over).alias("nxt"))
    w = Window.partitionBy("chrom", "part").orderBy("pos")
    y = s.withColumns({"run": F.sum("d").over(w), "to": F.lead("pos").over(w)}).join(parts, (F.col("chrom") == F.col("pc")) & (F.col("part") == F.col("pp")))
    y = y.select("chrom", F.col("pos").alias("chrom_start"), F.coalesce("to", "nxt").alias("chrom_end"), (F.col("run") + F.col("entry")).alias("depth"))
    return y.where("depth > 0")


# --- splitters -----------------------------------------------------------------------------------
def _explode_range(df: DataFrame, n: Column, start, end) -> DataFrame:
    x = df.withColumn("__n", n).where("__n > 0").withColumn("__i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)))
    return x.select("chrom", start(F.col("__i")).alias("chrom_start"), end(F.col("__i")).alias("chrom_end"))


def split_bed(df: DataFrame, k: int) -> DataFrame:
    """``k`` bins of ``floor(size / k)``; leftover bases are not covered; size below k gives zero-width bins."""
    w, s = F.floor(size() / F.lit(k)), F.col("chrom_start")
    return _explode_range(df.where("chrom_end >= chrom_start"), F.lit(k).cast("bigint"), lambda i: s + i * w, lambda i: s + (i + 1) * w)


def split_bed_by_size(df: DataFrame, step: int) -> DataFrame:
    """Full bins of ``step`` only."""
    s = F.col("chrom_start")
    return _explode_range(df, F.floor(size() / F.lit(step)), lambda i: s + i * step, lambda i: s + (i + 1) * step)


def split_bed_by_size_left(df: DataFrame, step: int) -> DataFrame:
    """Bins of ``step``; the last may reach past the end."""
    s = F.col("chrom_start")
    return _explode_range(df, F.ceil(size() / F.lit(step)), lambda i: s + i * step, lambda i: s + (i + 1) * step)


def split_bed_by_size_overlap(df: DataFrame, step: int, overlap: int) -> DataFrame:
    """Bins of ``step`` that share ``overlap`` bases with the next, while start + overlap lies before the end."""
    if overlap >= step:
        raise ValueError("the overlap must be smaller than the bin")
    s, d = F.col("chrom_start"), step - overlap
    return _explode_range(df, F.ceil((size() - overlap) / F.lit(d)), lambda i: s + i * d, lambda i: s + i * d + step)


def mono_clonalize(df: DataFrame, tie: str) -> DataFrame:
    """Drop a record whose position and strand equal those of the record before it, in the order
    (chrom, start, end, ``tie``). Runs are compared within one position, so no window spans a chrom."""
    w = Window.partitionBy(*BED3).orderBy(tie)
    x = df.withColumn("__rn", F.row_number().over(w)).withColumn("__p", F.lag("strand").over(w))
    return x.where((F.col("__rn") == 1) | ~F.col("strand").eqNullSafe(F.col("__p"))).drop("__rn", "__p")


def is_sorted(df: DataFrame, index: str, cols: list[str]) -> DataFrame:
    """One row ``ascending, descending``: whether the rows, ordered by ``index``, are monotone over ``cols``.

    The index (a whole number) is cut into ranges, each checked by its own task; summaries of neighbouring
    ranges (first and last row, and what was found) are merged a thousand at a time, in a tree.
    """
    x = df.select(F.col(index).cast("bigint").alias("p"), F.struct(*cols).alias("f")).withColumns({"l": F.col("f"), "dn": F.lit(False), "up": F.lit(False)})
    for _ in range(7):  # 1,000 ** 7 is above every BIGINT
        w = Window.partitionBy("g").orderBy("p")
        x = x.withColumn("g", F.floor(F.col("p") / F.lit(1000))).withColumn("b", F.lag("l").over(w))
        found = lambda c, test: F.max(F.col(c) | F.coalesce(test, F.lit(False))).alias(c)
        x = x.groupBy("g").agg(F.min_by("f", "p").alias("f"), F.max_by("l", "p").alias("l"), found("dn", F.col("f") < F.col("b")), found("up", F.col("f") > F.col("b"))).withColumnRenamed("g", "p")
    none = lambda c: (~F.coalesce(F.max(c), F.lit(False))).alias
    return x.agg(none("dn")("ascending"), none("up")("descending"))
