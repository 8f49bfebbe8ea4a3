import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import counting as ct, intervals as iv


def bed(spark, rows, chrom="chr1"):
    return spark.createDataFrame([(chrom, s, e) for s, e in rows], "chrom string, chrom_start bigint, chrom_end bigint")


def spans(df):
    return sorted((r.chrom_start, r.chrom_end) for r in df.collect())


def test_splitters(spark):
    b = bed(spark, [(0, 99)])
    assert spans(iv.split_bed_by_size(b, 20)) == [(0, 20), (20, 40), (40, 60), (60, 80)]
    assert spans(iv.split_bed_by_size_left(b, 20)) == [(i, i + 20) for i in range(0, 100, 20)]
    assert spans(iv.split_bed_by_size_overlap(b, 20, 10)) == [(i, i + 20) for i in range(0, 90, 10)]
    assert spans(iv.split_bed(b, 4)) == [(0, 24), (24, 48), (48, 72), (72, 96)]
    assert spans(iv.split_bed(bed(spark, [(5, 7)]), 3)) == [(5, 5)] * 3
    assert spans(iv.split_bed_by_size(bed(spark, [(5, 7), (7, 5)]), 3)) == []
    with pytest.raises(ValueError):
        iv.split_bed_by_size_overlap(b, 10, 10)


OVERLAPPED = [(0, 100), (10, 20), (50, 150), (120, 160), (155, 200), (155, 220), (0, 10), (0, 10)]


def test_depth_and_merge(spark):
    d = iv.depth_segments(bed(spark, [*OVERLAPPED, (7, 7)]))
    assert sorted((r.chrom_start, r.chrom_end, r.depth) for r in d.collect()) == [(0, 10, 3), (10, 20, 2), (20, 50, 1), (50, 100, 2), (100, 120, 1), (120, 150, 2), (150, 155, 1), (155, 160, 3), (160, 200, 2), (200, 220, 1)]
    assert spans(iv.merge_bed(bed(spark, [*OVERLAPPED[:6], (500, 1000)]))) == [(0, 220), (500, 1000)]
    assert spans(iv.merge_bed(bed(spark, [(0, 5), (5, 9), (10, 11)]))) == [(0, 9), (10, 11)]
    m = iv.merge_bed_with(bed(spark, OVERLAPPED), n=F.count(F.lit(1)), longest=F.max(F.col("chrom_end") - F.col("chrom_start")))
    assert [tuple(r) for r in m.collect()] == [("chr1", 0, 220, 8, 100)]


def rand(n, seed, long=0.1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randrange(-500, 3_000_000)
        ln = rng.choice([0, 1, 40_000, 900_000, 5_000_000]) if rng.random() < long else rng.randrange(-2, 400)
        out.append((i, rng.choice(["a", "b", None]), rng.choice([s, None]) if rng.random() < 0.02 else s, s + ln))
    return out


def frame(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} int, chrom string, chrom_start bigint, chrom_end bigint")


def hit(x, y, closed=False, within=False, containing=False):
    (_, c, s, e), (_, c2, s2, e2) = x, y
    if c is None or c != c2 or None in (s, s2):
        return False
    if not closed and (e <= s or e2 <= s2) or closed and (e < s or e2 < s2):
        return False
    if within:
        return s2 >= s and e2 <= e
    if containing:
        return s >= s2 and e <= e2
    return (s <= e2 and s2 <= e) if closed else (s < e2 and s2 < e)


@pytest.mark.parametrize("kw", [{}, {"closed": True}, {"within": True}, {"containing": True}])
def test_range_join(spark, kw):
    a, b = rand(300, 1), rand(300, 2)
    got = sorted((r.id, r.b_id) for r in iv.range_join(frame(spark, a), frame(spark, b), **kw).select("id", "b_id").collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if hit(x, y, **kw))


def test_semi_anti_collect(spark):
    a, b = rand(200, 3) + rand(5, 3), rand(60, 4)
    fa, fb = frame(spark, a), frame(spark, b)
    yes = sorted(x[0] for x in a if any(hit(x, y) for y in b))
    assert sorted(r.id for r in iv.intersect_bed(fa, fb).collect()) == yes
    assert sorted(r.id for r in iv.intersect_bed(fa, fb, negate=True).collect()) == sorted(x[0] for x in a if not any(hit(x, y) for y in b))
    w = iv.intersect_bed_with(fa, fb).collect()
    assert len(w) == len(a) and w[0].overlaps is not None
    got = sorted((r.id, tuple(o.id for o in r.overlaps)) for r in w)
    assert got == sorted((x[0], tuple(y[0] for y in sorted((y for y in b if hit(x, y)), key=lambda y: (y[2], y[3], y[0])))) for x in a)
    assert iv.intersect_bed(fa, fb.limit(0)).count() == 0 and iv.intersect_bed(fa.limit(0), fb).count() == 0


def test_left_side_in_another_order_each_time(spark):
    """Neither the semi nor the collecting join may rely on rows that are numbered twice."""
    base = spark.range(20_000).selectExpr("id", "concat('c', id % 3) chrom", "id * 10 chrom_start", "id * 10 + 5 chrom_end")
    a = base.orderBy(F.rand())
    b = base.where("id % 100 = 7").select("chrom", "chrom_start", "chrom_end")
    want = [i for i in range(20_000) if i % 100 == 7]
    assert sorted(r.id for r in iv.intersect_bed(a, b).collect()) == want
    assert iv.intersect_bed(a, b, negate=True).count() == 19_800
    w = {r.id: len(r.overlaps) for r in iv.intersect_bed_with(a, b).collect()}
    assert len(w) == 20_000 and {k for k, v in w.items() if v == 1} == set(want) and sum(w.values()) == 200


def test_one_long_interval_does_not_gather_all_short_ones(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k) for k in conf}
    short = spark.range(1_000_000).selectExpr("id", "'c' chrom", "id * 1000 chrom_start", "id * 1000 + 50 chrom_end")
    long_ = spark.createDataFrame([("c", 0, 1 << 30)], "chrom string, chrom_start bigint, chrom_end bigint")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for j in (iv.range_join(short, long_), iv.range_join(long_, short)):
            n = [r["count"] for r in j.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(n) == 1_000_000 and max(n) < 100_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_depth_of_one_dense_period(spark):
    rng = random.Random(8)
    rows = [("c", s, s + rng.randrange(1, 60)) for s in (rng.randrange(3000) for _ in range(2000))] + [(None, 1, 5), ("d", 4, 4)]
    df = spark.createDataFrame(rows, "chrom string, chrom_start bigint, chrom_end bigint")
    got = sorted((r.chrom_start, r.chrom_end, r.depth) for r in iv.depth_segments(df).collect())
    cov = [0] * 3100
    for _, s, e in rows[:-2]:
        for i in range(s, e):
            cov[i] += 1
    assert all(cov[i] == d for s, e, d in got for i in range(s, e)) and sum(e - s for s, e, _ in got) == sum(c > 0 for c in cov)
    assert {s for s, _, _ in got} | {e for _, e, _ in got} == {x for _, s, e in rows[:-2] for x in (s, e)}


def test_clip_sort_clonal(spark):
    b = spark.createDataFrame([("a", -5, 3), ("a", -5, -1), ("a", 8, 20), ("a", 10, 12), ("z", 1, 2)], "chrom string, chrom_start bigint, chrom_end bigint")
    sz = spark.createDataFrame([("a", 10)], "chrom string, size bigint")
    assert spans(iv.clip_bed(b, sz)) == [(0, 3), (8, 10)]
    assert spans(iv.clip_bed(b, sz, keep_inverted=True)) == [(0, -1), (0, 3), (8, 10)]
    with pytest.raises(Exception, match="two sizes"):
        iv.clip_bed(b, sz.union(sz)).collect()
    s = spark.createDataFrame([(c, 1, 2) for c in ["chr10", "Chr1", "chrM", "chr2", "chr1"]], b.schema)
    assert [r.chrom for r in iv.sort_bed(s).collect()] == ["Chr1", "chr1", "chr10", "chr2", "chrM"]
    t = spark.createDataFrame([("a", 1, 2, x, i) for i, x in enumerate([True, False, True, True, None, None])], "chrom string, chrom_start int, chrom_end int, strand boolean, id int")
    assert sorted(r.id for r in iv.mono_clonalize(t, "id").collect()) == [0, 1, 2, 4]
    v = spark.createDataFrame([(i, i // 2) for i in range(10)], "i int, v int")
    assert tuple(iv.is_sorted(v, "i", ["v"]).collect()[0]) == (True, False)
    assert tuple(iv.is_sorted(v.limit(0), "i", ["v"]).collect()[0]) == (True, True)
    far = spark.range(5000).selectExpr("id * 77777777 i", "-id v")
    assert tuple(iv.is_sorted(far.repartition(7), "i", ["v"]).collect()[0]) == (False, True)
    one = far.selectExpr("i", "CASE WHEN i = 77777777L * 3000 THEN 1 ELSE v END v")
    assert tuple(iv.is_sorted(one, "i", ["v"]).collect()[0]) == (False, False)


def test_counting(spark):
    rng = random.Random(9)
    regions = [(i, "a", s, s + rng.choice([0, 30, 99, 100, 250, 3000])) for i, s in enumerate(rng.randrange(20_000) for _ in range(40))]
    tags = [(i, rng.choice(["a", "b"]), s, s + rng.choice([1, 36, 400]), rng.random() < 0.5) for i, s in enumerate(rng.randrange(20_000) for _ in range(500))]
    r = spark.createDataFrame(regions, "region_id int, chrom string, chrom_start bigint, chrom_end bigint")
    t = spark.createDataFrame(tags, "id int, chrom string, chrom_start bigint, chrom_end bigint, strand boolean")
    p5 = [(c, s if st else e - 1) for _, c, s, e, st in tags]
    n = {i: sum(c == c2 and s <= p < e for c2, p in p5) for i, c, s, e in regions}
    assert {x.region_id: x.n for x in ct.count_tags(r, t).collect()} == n
    k = 100
    want = {}
    whole = {}
    for i, c, s, e in regions:
        nb = (e - s) // k
        v, w = [0] * nb, [0] * nb
        for c2, p in p5:
            if nb and c == c2 and s <= p < e:
                v[min((p - s) // k, nb - 1)] += 1
        for _, c2, ts, te, _ in tags:
            if nb and c == c2 and ts < e and s < te:
                for b in range(max(0, (ts - s) // k), min((te - s) // k, nb - 1) + 1):
                    w[b] += 1
        want[i], whole[i] = v, w
    assert {x.region_id: x.counts for x in ct.count_tags_bin(r, t, k).collect()} == want
    assert {x.region_id: x.counts for x in ct.count_tags_bin_whole(r, t, k).collect()} == whole
    bm = {(c, p) for c, p in p5}
    hits = {x.region_id: x.hits for x in ct.query_base_map(r.withColumn("strand", F.lit(False)), ct.base_map(t), t.select("chrom")).collect()}
    assert hits == {i: [("a", p) in bm for p in range(s, e)][::-1] for i, c, s, e in regions}
    with pytest.raises(Exception, match="unknown strand"):
        ct.count_tags(r, t.withColumn("strand", F.lit(None).cast("boolean"))).collect()


def test_closed_and_correlation(spark):
    r = spark.createDataFrame([(1, "a", 10, 20), (2, "a", 40, 50), (3, "b", 0, 5)], "region_id int, chrom string, chrom_start bigint, chrom_end bigint")
    t = spark.createDataFrame([("a", 20, 25), ("a", 12, 14), ("a", 12, 14), ("a", 0, 100)], "chrom string, chrom_start bigint, chrom_end bigint")
    assert {x.region_id: x.n for x in ct.overlap_fragments(r, t).collect()} == {1: 4, 2: 1, 3: 0}
    assert {x.region_id: x.n for x in ct.overlap_nucleotides(r, t).collect()} == {1: 1 + 3 + 3 + 11, 2: 11, 3: 0}
    c = {x.region_id: (x.coverage, x.tag_bases) for x in ct.coverage(r, t).collect()}
    assert c[1] == (1.8, 6 + 3 + 3 + 101) and c[3][0] == 0
    rng = random.Random(4)
    tags = [("a", s, s + 10, rng.random() < 0.5) for s in (rng.randrange(300) for _ in range(60))]
    df = spark.createDataFrame(tags, "chrom string, chrom_start bigint, chrom_end bigint, strand boolean")
    fw, rv = {s for _, s, _, st in tags if st}, {e for _, _, e, st in tags if not st}
    want = {d: sum(any(r0 - d - 4 <= f <= r0 - d + 4 for f in fw) for r0 in rv) for d in range(10, 40, 2)}
    assert {x.d: x.cc for x in ct.cross_correlation(df, list(range(10, 40, 2))).collect()} == want
    assert ct.fragment_length(df, 10, 38).collect()[0][0] == max(want, key=lambda d: (want[d], d))


def test_fragment_length_query_tries_every_shift(spark, tmp_path):
    from helixframe.plans import genomics

    rows = [(i, "a", 1000 * i, 1000 * i + 30, None, None, True) for i in range(9)] + [(9 + i, "a", 1000 * i + 54, 1000 * i + 84, None, None, False) for i in range(9)]
    spark.createDataFrame(rows, "rec_id bigint, chrom string, chrom_start bigint, chrom_end bigint, bed_name string, bed_score int, bed_strand boolean").write.parquet(f"{tmp_path}/bed.parquet")
    got = {x.d: x.cc for x in genomics.QUERIES["a19_cross_correlation_all"](spark, str(tmp_path)).collect()}
    assert got == {d: 9 if abs(d - 84) <= 4 else 0 for d in range(50, 131, 2)}
    assert genomics.QUERIES["a18_fragment_length_all"](spark, str(tmp_path)).collect()[0][0] == 88


def test_peaks_and_histogram(spark):
    p = bed(spark, [(0, 10), (5, 15), (1000, 1011), (-9, -4)])
    assert sorted((x.chrom_start, x.chrom_end, x.score) for x in ct.peak_cluster(p, 10, 2).collect()) == [(-17, 20, 3)]
    h = {x.tags_at_position: x.n_positions for x in ct.tag_count_distribution(bed(spark, [(1, 2)] * 120 + [(5, 6)]).withColumn("strand", F.lit(None).cast("boolean"))).collect()}
    assert len(h) == 100 and h[99] == 1 and h[1] == 1 and sum(h.values()) == 2
    g = spark.createDataFrame([("chr1", 0, 10, 2.0), ("chr1", 5, 100, 1.0)], "chrom string, chrom_start bigint, chrom_end bigint, value double")
    r = bed(spark, [(0, 20), (500, 600)]).withColumn("region_id", F.col("chrom_start"))
    assert {x.region_id: x.score for x in ct.interval_scores(r, g).collect()} == {0: 115.0, 500: 0.0}
