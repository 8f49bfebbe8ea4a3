"""Queries of the interval, counting, sequence, statistics, annotation, motif and contact operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.functions import sequence as sq, stats
from helixframe.operators import annotation as an, contacts as hc, counting as ct, intervals as iv, references as rf
from helixframe.plans import derive as dv
from helixframe.plans.derive import SQL
from helixframe.runtime import materialize, read_table
from helixframe.sources import codecs, formats, genome as gn

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *parts: str, queries: dict | None = None, oracle: dict | None = None):
    """Register a query under its function's name, with its SQL (``parts`` name shared tables)."""

    def add(f):
        (QUERIES if queries is None else queries)[f.__name__] = f
        if sql:
            (ORACLE if oracle is None else oracle)[f.__name__] = ("WITH " + ", ".join(SQL[p] for p in parts) + " " if parts else "") + sql
        return f

    return add


def _csv(c: str):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)


_OV = "t.chrom = p.chrom AND t.chrom_start < p.chrom_end AND p.chrom_start < t.chrom_end AND t.chrom_end > t.chrom_start AND p.chrom_end > p.chrom_start"


SQL["annot"] = "a AS (SELECT gaf_db_id AS item, trim(gaf_go_id) AS term FROM gaf WHERE trim(gaf_go_id) <> ''), fg AS (SELECT DISTINCT gaf_db_id AS f FROM gaf WHERE gaf_aspect = 'P')"
SQL["rows"] = "rs AS (SELECT i, sum(value)::DOUBLE AS s FROM (SELECT i, value FROM m UNION ALL SELECT j, value FROM m WHERE i <> j) GROUP BY i)"
SQL["reads"] = "reads AS (SELECT * FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^!-~]', '', 'g') AS qual FROM documents) WHERE qual <> '')"
# --- intervals -----------------------------------------------------------------------------------
@query(f"SELECT rec_id, region_id, least(t.chrom_end, p.chrom_end) - greatest(t.chrom_start, p.chrom_start) AS shared FROM tags t JOIN peaks p ON {_OV}", "tags", "peaks")
def j2_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = iv.range_join(dv.tags(spark, d), dv.peaks(spark, d))
    c = F.col
    return x.select("rec_id", c("b_region_id").alias("region_id"), iv.size_overlapped(c("chrom"), c("chrom_start"), c("chrom_end"), c("b_chrom"), c("b_chrom_start"), c("b_chrom_end")).alias("shared"))


@query(f"SELECT rec_id, region_id FROM tags t JOIN peaks p ON {_OV} AND p.chrom_start >= t.chrom_start AND p.chrom_end <= t.chrom_end", "tags", "peaks")
def j3_within_pairs(spark: SparkSession, d: str) -> DataFrame:
    return iv.range_join(dv.tags(spark, d), dv.peaks(spark, d), within=True).select("rec_id", F.col("b_region_id").alias("region_id"))


@query(f"SELECT rec_id, p.chrom_start AS key_start, p.chrom_end AS key_end FROM tags t JOIN (SELECT DISTINCT chrom, chrom_start, chrom_end FROM peaks) p ON {_OV}", "tags", "peaks")
def j4_query_intersect(spark: SparkSession, d: str) -> DataFrame:
    return iv.query_intersect(dv.tags(spark, d), dv.peaks(spark, d)).select("rec_id", F.col("b_chrom_start").alias("key_start"), F.col("b_chrom_end").alias("key_end"))


@query(f"SELECT rec_id, chrom, chrom_start, chrom_end FROM tags t WHERE EXISTS (SELECT 1 FROM peaks p WHERE {_OV})", "tags", "peaks")
def j6_intersect_semi(spark: SparkSession, d: str) -> DataFrame:
    return iv.intersect_bed(dv.tags(spark, d).select("rec_id", *iv.BED3), dv.peaks(spark, d))


@query(f"SELECT rec_id FROM tags t WHERE NOT EXISTS (SELECT 1 FROM peaks p WHERE {_OV})", "tags", "peaks")
def j11_anti(spark: SparkSession, d: str) -> DataFrame:
    return iv.intersect_bed(dv.tags(spark, d), dv.peaks(spark, d), negate=True).select("rec_id")


@query(f"""SELECT rec_id, count(region_id) AS n, coalesce(string_agg(region_id::VARCHAR, ',' ORDER BY p.chrom_start, p.chrom_end, region_id), '') AS ids
  FROM tags t LEFT JOIN peaks p ON {_OV} GROUP BY rec_id""", "tags", "peaks")
def j7_intersect_with(spark: SparkSession, d: str) -> DataFrame:
    x = iv.intersect_bed_with(dv.tags(spark, d).select("rec_id", *iv.BED3), dv.peaks(spark, d).select(*iv.BED3, "region_id"))
    return x.select("rec_id", F.size("overlaps").cast("bigint").alias("n"), F.array_join(F.transform("overlaps", lambda o: o["region_id"].cast("string")), ",").alias("ids"))


@query("SELECT chrom, chrom_start, chrom_end, count(*) AS n FROM tags GROUP BY ALL", "tags")
def j1_build_side(spark: SparkSession, d: str) -> DataFrame:
    return iv.build_side(dv.tags(spark, d), n=F.count(F.lit(1)))


_MERGED = """b AS (SELECT * FROM tags WHERE chrom_end > chrom_start),
 mm AS (SELECT *, max(chrom_end) OVER (PARTITION BY chrom ORDER BY chrom_start, chrom_end, rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM b),
 gg AS (SELECT *, sum(CASE WHEN pe IS NULL OR chrom_start > pe THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY chrom_start, chrom_end, rec_id ROWS UNBOUNDED PRECEDING) AS isl FROM mm)"""
SQL["merged"] = _MERGED


@query("SELECT chrom, min(chrom_start) AS chrom_start, max(chrom_end) AS chrom_end FROM gg GROUP BY chrom, isl", "tags", "merged")
def a1_merge(spark: SparkSession, d: str) -> DataFrame:
    return iv.merge_bed(dv.tags(spark, d))


@query("SELECT chrom, min(chrom_start) AS chrom_start, max(chrom_end) AS chrom_end, count(*) AS n, max(score) AS best FROM gg GROUP BY chrom, isl", "tags", "merged")
def a2_merge_with(spark: SparkSession, d: str) -> DataFrame:
    return iv.merge_bed_with(dv.tags(spark, d).select(*iv.BED3, "score"), n=F.count(F.lit(1)), best=F.max("score"))


@query("""SELECT chrom, pos AS chrom_start, nxt AS chrom_end, depth FROM (SELECT chrom, pos, lead(pos) OVER w AS nxt, sum(d) OVER w AS depth FROM
  (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, chrom_start AS pos, 1 AS d FROM tags WHERE chrom_end > chrom_start UNION ALL SELECT chrom, chrom_end, -1 FROM tags WHERE chrom_end > chrom_start) GROUP BY ALL)
  WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE depth > 0""", "tags")
def a3_depth(spark: SparkSession, d: str) -> DataFrame:
    return iv.depth_segments(dv.tags(spark, d))


@query("""SELECT rec_id, greatest(chrom_start, 0) AS chrom_start, least(chrom_end, size) AS chrom_end FROM tags JOIN
  (SELECT chrom, floor(max(chrom_end) * 3 / 4)::BIGINT AS size FROM tags GROUP BY chrom) USING (chrom) WHERE chrom_start < size AND least(chrom_end, size) > greatest(chrom_start, 0)""", "tags")
def iv_clip(spark: SparkSession, d: str) -> DataFrame:
    return iv.clip_bed(dv.tags(spark, d), dv.sizes(spark, d)).select("rec_id", "chrom_start", "chrom_end")


@query("SELECT rec_id, chrom, chrom_start, chrom_end FROM tags ORDER BY chrom, chrom_start, chrom_end", "tags")
def w1_sort(spark: SparkSession, d: str) -> DataFrame:
    return iv.sort_bed(dv.tags(spark, d).select("rec_id", *iv.BED3))


_SPLIT = "SELECT chrom, chrom_start + i * {w} AS chrom_start, chrom_start + i * {w} + {n} AS chrom_end FROM (SELECT *, unnest(range({k})) AS i FROM peaks WHERE {ok}) "


@query("SELECT chrom, chrom_start + i * w AS chrom_start, chrom_start + (i + 1) * w AS chrom_end FROM (SELECT *, (chrom_end - chrom_start) // 7 AS w, unnest(range(7)) AS i FROM peaks WHERE chrom_end >= chrom_start)", "peaks")
def g1_split(spark: SparkSession, d: str) -> DataFrame:
    return iv.split_bed(dv.peaks(spark, d), 7)


@query(_SPLIT.format(w=100, n=100, k="(chrom_end - chrom_start) // 100", ok="chrom_end > chrom_start"), "peaks")
def g2_split_by_size(spark: SparkSession, d: str) -> DataFrame:
    return iv.split_bed_by_size(dv.peaks(spark, d), 100)


@query(_SPLIT.format(w=100, n=100, k="(chrom_end - chrom_start + 99) // 100", ok="chrom_end > chrom_start"), "peaks")
def g3_split_by_size_left(spark: SparkSession, d: str) -> DataFrame:
    return iv.split_bed_by_size_left(dv.peaks(spark, d), 100)


@query(_SPLIT.format(w=70, n=100, k="(chrom_end - chrom_start - 30 + 69) // 70", ok="chrom_end - chrom_start > 30"), "peaks")
def g4_split_by_size_overlap(spark: SparkSession, d: str) -> DataFrame:
    return iv.split_bed_by_size_overlap(dv.peaks(spark, d), 100, 30)


@query("""SELECT rec_id FROM (SELECT rec_id, strand, row_number() OVER w AS rn, lag(strand) OVER w AS prev FROM tags WINDOW w AS (PARTITION BY chrom, chrom_start, chrom_end ORDER BY rec_id))
  WHERE rn = 1 OR strand IS DISTINCT FROM prev""", "tags")
def iv_monoclonal(spark: SparkSession, d: str) -> DataFrame:
    return iv.mono_clonalize(dv.tags(spark, d), "rec_id").select("rec_id")


_SORTED = "SELECT coalesce(bool_and(NOT coalesce(v < b, false)), true) AS ascending, coalesce(bool_and(NOT coalesce(v > b, false)), true) AS descending FROM (SELECT {v} AS v, lag({v}) OVER (ORDER BY {i}) AS b FROM {t})"


@query(_SORTED.format(v="row(chrom, chrom_start, chrom_end)", i="rec_id", t="tags"), "tags")
def w7_is_sorted(spark: SparkSession, d: str) -> DataFrame:
    return iv.is_sorted(dv.tags(spark, d), "rec_id", ["chrom", "chrom_start", "chrom_end"])


@query(_SORTED.format(v="row(o_orderkey // 3, o_orderkey)", i="o_orderkey", t="orders"))
def w7_is_sorted_up(spark: SparkSession, d: str) -> DataFrame:
    return iv.is_sorted(read_table(spark, d, "orders").withColumn("k", F.floor(F.col("o_orderkey") / 3)), "o_orderkey", ["k", "o_orderkey"])


@query(_SORTED.format(v="row(-(event_id // 7))", i="event_id", t="events"))
def w7_is_sorted_down(spark: SparkSession, d: str) -> DataFrame:
    return iv.is_sorted(read_table(spark, d, "events").withColumn("k", -F.floor(F.col("event_id") / 7)), "event_id", ["k"])


# --- counting ------------------------------------------------------------------------------------
_IN = "st.chrom = p.chrom AND st.p5 >= p.chrom_start AND st.p5 < p.chrom_end"


@query(f"SELECT region_id, count(st.chrom) AS n FROM peaks p LEFT JOIN st ON {_IN} GROUP BY region_id", "st", "peaks")
def a5_count_tags(spark: SparkSession, d: str) -> DataFrame:
    return ct.count_tags(dv.peaks(spark, d), dv.stranded_tags(spark, d))


@query(f"""SELECT region_id, CASE WHEN any_value(p.chrom_end - p.chrom_start) = 0 THEN 'nan'::DOUBLE ELSE count(st.chrom) * 1e9 / (SELECT count(*) FROM st) / any_value(p.chrom_end - p.chrom_start) END AS rpkm
  FROM peaks p LEFT JOIN st ON {_IN} GROUP BY region_id""", "st", "peaks")
def a4_rpkm(spark: SparkSession, d: str) -> DataFrame:
    return ct.rpkm(dv.peaks(spark, d), dv.stranded_tags(spark, d))


_DENSE = """SELECT region_id, coalesce(string_agg(n::VARCHAR, ',' ORDER BY i), '') AS counts FROM (SELECT p.region_id, b.i, coalesce(c.n, 0) AS n FROM peaks p
  LEFT JOIN (SELECT region_id, unnest(range((chrom_end - chrom_start) // 100)) AS i FROM peaks) b USING (region_id) LEFT JOIN c ON c.region_id = p.region_id AND c.i = b.i WHERE TRUE) GROUP BY region_id"""
SQL["c_points"] = f"c AS (SELECT region_id, least((p5 - p.chrom_start) // 100, (p.chrom_end - p.chrom_start) // 100 - 1) AS i, count(*) AS n FROM peaks p JOIN st ON {_IN} WHERE p.chrom_end - p.chrom_start >= 100 GROUP BY ALL)"


@query(_DENSE.replace("coalesce(c.n, 0) AS n", "CASE WHEN b.i IS NOT NULL THEN coalesce(c.n, 0) END AS n"), "st", "peaks", "c_points")
def a6_count_tags_bin(spark: SparkSession, d: str) -> DataFrame:
    return ct.count_tags_bin(dv.peaks(spark, d), dv.stranded_tags(spark, d), 100).select("region_id", _csv("counts"))


@query(f"""SELECT region_id, i, count(*) AS n FROM (SELECT region_id, unnest(range(CASE WHEN t.chrom_start < p.chrom_start THEN 0 ELSE (t.chrom_start - p.chrom_start) // 100 END,
  least((t.chrom_end - p.chrom_start) // 100, (p.chrom_end - p.chrom_start) // 100 - 1) + 1)) AS i FROM tags t JOIN peaks p ON {_OV} WHERE p.chrom_end - p.chrom_start >= 100) GROUP BY ALL""", "tags", "peaks")
def a7_count_tags_bin_whole(spark: SparkSession, d: str) -> DataFrame:
    x = ct.count_tags_bin_whole(dv.peaks(spark, d), dv.tags(spark, d), 100)
    return x.select("region_id", F.posexplode("counts").alias("i", "n")).where("n > 0").select("region_id", F.col("i").cast("bigint").alias("i"), "n")


@query("SELECT DISTINCT chrom, CASE WHEN strand IS DISTINCT FROM false THEN chrom_start ELSE chrom_end - 1 END AS pos FROM tags", "tags")
def a8_base_map(spark: SparkSession, d: str) -> DataFrame:
    return ct.base_map(dv.tags(spark, d))


@query("""SELECT region_id, count(x.pos) AS n_hits, string_agg(CASE WHEN p.strand IS DISTINCT FROM false THEN x.pos - p.chrom_start ELSE p.chrom_end - 1 - x.pos END::VARCHAR, ',' ORDER BY CASE WHEN p.strand IS DISTINCT FROM false THEN x.pos ELSE -x.pos END) AS at
  FROM peaks p JOIN (SELECT DISTINCT chrom, CASE WHEN strand IS DISTINCT FROM false THEN chrom_start ELSE chrom_end - 1 END AS pos FROM tags) x ON x.chrom = p.chrom AND x.pos >= p.chrom_start AND x.pos < p.chrom_end GROUP BY region_id""", "tags", "peaks")
def a9_query_base_map(spark: SparkSession, d: str) -> DataFrame:
    t = dv.tags(spark, d)
    x = ct.query_base_map(dv.peaks(spark, d), ct.base_map(t), t.select("chrom"))
    at = F.filter(F.transform("hits", lambda h, i: F.when(h, i)), lambda v: v.isNotNull())
    return x.select("region_id", F.size(at).cast("bigint").alias("n_hits"), F.array_join(F.transform(at, lambda v: v.cast("string")), ",").alias("at")).where("n_hits > 0")


@query("""SELECT tags_at_position, coalesce(n, 0) AS n_positions FROM (SELECT unnest(range(100)) AS tags_at_position) LEFT JOIN (SELECT least(c, 99) AS k, count(*) AS n FROM
  (SELECT chrom, coalesce(strand, true) AS s, CASE WHEN strand IS DISTINCT FROM false THEN chrom_start ELSE chrom_end - 1 END AS p, count(*) AS c FROM tags GROUP BY ALL) GROUP BY ALL) ON k = tags_at_position""", "tags")
def a10_tag_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ct.tag_count_distribution(dv.tags(spark, d))


SQL["windows"] = """w0 AS (SELECT np_chrom AS chrom, floor((np_start + np_end) / 2.0)::BIGINT - 2000 AS s, floor((np_start + np_end) / 2.0)::BIGINT + 2000 AS e, peak_id FROM narrowpeak),
 w1 AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e, peak_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM w0),
 w2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e, peak_id ROWS UNBOUNDED PRECEDING) AS isl FROM w1)"""


@query("SELECT chrom, min(s) AS chrom_start, max(e) AS chrom_end, count(*) AS score FROM w2 GROUP BY chrom, isl HAVING count(*) >= 2", "windows")
def a11_peak_cluster(spark: SparkSession, d: str) -> DataFrame:
    return ct.peak_cluster(dv.peaks(spark, d), 2000, 2)


_CL = "t.chrom = p.chrom AND t.chrom_start <= p.chrom_end AND p.chrom_start <= t.chrom_end AND t.chrom_end >= t.chrom_start AND p.chrom_end >= p.chrom_start"


@query(f"SELECT region_id, count(t.chrom) AS n FROM peaks p LEFT JOIN tags t ON {_CL} GROUP BY region_id", "tags", "peaks")
def a16_overlap_fragments(spark: SparkSession, d: str) -> DataFrame:
    return ct.overlap_fragments(dv.peaks(spark, d), dv.tags(spark, d))


@query(f"SELECT region_id, coalesce(sum(CASE WHEN t.chrom IS NOT NULL THEN least(t.chrom_end, p.chrom_end) - greatest(t.chrom_start, p.chrom_start) + 1 END), 0)::BIGINT AS n FROM peaks p LEFT JOIN tags t ON {_CL} GROUP BY region_id", "tags", "peaks")
def a17_overlap_nucleotides(spark: SparkSession, d: str) -> DataFrame:
    return ct.overlap_nucleotides(dv.peaks(spark, d), dv.tags(spark, d))


@query(f"""SELECT region_id, CASE WHEN any_value(p.chrom_end - p.chrom_start) = 0 THEN 'nan'::DOUBLE ELSE coalesce(sum(CASE WHEN t.chrom IS NOT NULL THEN least(t.chrom_end, p.chrom_end) - greatest(t.chrom_start, p.chrom_start) + 1 END), 0)::DOUBLE / any_value(p.chrom_end - p.chrom_start) END AS coverage,
  (SELECT sum(chrom_end - chrom_start + 1) FROM tags)::BIGINT AS tag_bases FROM peaks p LEFT JOIN tags t ON {_CL} GROUP BY region_id""", "tags", "peaks")
def a15_coverage(spark: SparkSession, d: str) -> DataFrame:
    return ct.coverage(dv.peaks(spark, d), dv.tags(spark, d))


_SHIFTS = list(range(50, 131, 20))
SQL["cc"] = f"""f AS (SELECT DISTINCT chrom, chrom_start AS f FROM st WHERE strand), r AS (SELECT DISTINCT chrom, chrom_end AS r FROM st WHERE NOT strand), ds AS (SELECT unnest({_SHIFTS}) AS d),
 hit AS (SELECT DISTINCT d, chrom, r FROM ds JOIN (SELECT r.chrom, r, f FROM r JOIN f ON r.chrom = f.chrom AND f >= r - 134 AND f <= r - 46) ON abs(r - f - d) <= 4)"""


@query("SELECT ds.d::INTEGER AS d, count(r) AS cc FROM ds LEFT JOIN hit USING (d) GROUP BY ds.d", "st", "cc")
def a19_cross_correlation(spark: SparkSession, d: str) -> DataFrame:
    return ct.cross_correlation(dv.stranded_tags(spark, d), _SHIFTS)


@query("SELECT d::INTEGER AS fragment_length FROM (SELECT d, count(r) AS c FROM ds LEFT JOIN hit USING (d) GROUP BY d) ORDER BY c DESC, d DESC LIMIT 1", "st", "cc")
def a18_fragment_length(spark: SparkSession, d: str) -> DataFrame:
    return ct.fragment_length(dv.stranded_tags(spark, d), 50, 130, 20)


#: All shifts of the reference over this range: its step is fixed at 2. The two queries above thin them to every tenth.
_ALL_SHIFTS = list(range(50, 131, 2))
SQL["cc_all"] = f"""f AS (SELECT DISTINCT chrom, chrom_start AS f FROM st WHERE strand), r AS (SELECT DISTINCT chrom, chrom_end AS r FROM st WHERE NOT strand), ds AS (SELECT unnest({_ALL_SHIFTS}) AS d),
 near AS (SELECT chrom, r, r - delta AS f, delta FROM r, (SELECT unnest(range(46, 135)) AS delta)), pairs AS (SELECT chrom, r, delta FROM near SEMI JOIN f USING (chrom, f)),
 hit AS (SELECT DISTINCT d, chrom, r FROM pairs JOIN ds ON abs(delta - d) <= 4)"""


@query("SELECT ds.d::INTEGER AS d, count(r) AS cc FROM ds LEFT JOIN hit USING (d) GROUP BY ds.d", "st", "cc_all")
def a19_cross_correlation_all(spark: SparkSession, d: str) -> DataFrame:
    """The cross-correlation at every shift of the reference."""
    return ct.cross_correlation(dv.stranded_tags(spark, d), _ALL_SHIFTS)


@query("SELECT d::INTEGER AS fragment_length FROM (SELECT d, count(r) AS c FROM ds LEFT JOIN hit USING (d) GROUP BY d) ORDER BY c DESC, d DESC LIMIT 1", "st", "cc_all")
def a18_fragment_length_all(spark: SparkSession, d: str) -> DataFrame:
    """The fragment length over every shift of the reference."""
    return ct.fragment_length(dv.stranded_tags(spark, d), 50, 130)


@query(f"SELECT region_id, coalesce(sum(t.score * (t.chrom_end - t.chrom_start)), 0)::DOUBLE AS score FROM peaks p LEFT JOIN tags t ON {_OV} GROUP BY region_id", "tags", "peaks")
def a20_interval_scores(spark: SparkSession, d: str) -> DataFrame:
    return ct.interval_scores(dv.peaks(spark, d), dv.tags(spark, d).select(*iv.BED3, F.col("score").cast("double").alias("value")))


# --- sequences -----------------------------------------------------------------------------------
_REV = "reverse(translate(seq, 'ACGT', 'TGCA'))"


@query(f"SELECT doc_id, md5({_REV}) AS rc_md5, CASE WHEN seq = '' THEN 'nan'::DOUBLE ELSE round(length(regexp_replace(seq, '[AT]', '', 'g')) / length(seq), 9) END AS gc FROM seqs", "seqs")
def f1_reverse_complement_gc(spark: SparkSession, d: str) -> DataFrame:
    return dv.sequences(spark, d).select("doc_id", F.md5(sq.reverse_complement(F.col("seq"))).alias("rc_md5"), F.round(sq.gc_content(F.col("seq")), 9).alias("gc"))


@query("SELECT doc_id, " + ", ".join(f"length(seq) - length(replace(seq, '{c}', '')) AS n_{c.lower()}" for c in "ACGT") + " FROM seqs", "seqs")
def a13_nucleotide_freq(spark: SparkSession, d: str) -> DataFrame:
    return dv.sequences(spark, d).withColumn("f", sq.nucleotide_freq(F.col("seq"))).select("doc_id", *[F.col("f")[c].cast("bigint").alias(f"n_{c.lower()}") for c in "ACGT"])


@query("SELECT doc_id, CASE WHEN regexp_full_match(upper(text), '[ACGTNVHDBMKWSYR]*') THEN upper(text) END AS seq FROM documents")
def f3_validate(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", sq.validated(F.col("text"), sq.DNA_IUPAC).alias("seq"))


@query("""SELECT doc_id, length(CASE WHEN length(s) - length(rtrim(s, 'A')) >= 3 THEN rtrim(s, 'A') ELSE s END) AS kept FROM (SELECT doc_id, seq || repeat('A', (doc_id % 6)::INTEGER) AS s FROM seqs)""", "seqs")
def f8_trim_poly_a(spark: SparkSession, d: str) -> DataFrame:
    x = dv.sequences(spark, d).withColumn("s", F.concat("seq", F.repeat(F.lit("A"), (F.col("doc_id") % 6).cast("int"))))
    return x.select("doc_id", F.length(sq.poly_a_trimmed(F.col("s"), F.col("s"), 3)[0]).cast("bigint").alias("kept"))


@query("""SELECT cycle, count(*) AS n, round(avg(q), 6) AS mean, round(var_pop(q), 6) AS var FROM (SELECT i - 1 AS cycle, ascii(qual[i]) - 33 AS q FROM (SELECT qual, unnest(range(1, (SELECT min(length(qual)) FROM reads) + 1)) AS i FROM reads)) GROUP BY cycle""", "reads")
def a12_quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return sq.quality_summary(dv.reads(spark, d)).select(F.col("cycle").cast("bigint").alias("cycle"), "n", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query("SELECT doc_id, i * 1000 AS chrom_start, md5(seq[i * 1000 + 1 : least((i + 1) * 1000, length(seq))]) AS seq_md5 FROM (SELECT doc_id, seq, unnest(range((length(seq) + 999) // 1000)) AS i FROM seqs)", "seqs")
def s25_get_seq(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 1,000 bases of every sequence, cut out of a chunk table."""
    s = dv.sequences(spark, d).where("seq != ''")
    fa = s.select(F.col("doc_id").cast("string").alias("header"), F.array("seq").alias("body"))
    r = s.select("doc_id", F.col("doc_id").cast("string").alias("chrom"), F.length("seq").alias("n"), F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / 1000).cast("int"))).alias("i"))
    r = r.select("doc_id", "chrom", (F.col("i") * 1000).cast("bigint").alias("chrom_start"), F.least((F.col("i") + 1) * 1000, F.col("n")).cast("bigint").alias("chrom_end"), F.concat_ws(":", "chrom", "i").alias("region_id"))
    return gn.get_seq(r, gn.chunk_table(fa, 1 << 12), chunk=1 << 12).select("doc_id", "chrom_start", F.md5("seq").alias("seq_md5"))


# --- statistics ----------------------------------------------------------------------------------
@query("SELECT event_id, round(asinh(0.5 * value) / 0.5, 6) AS y FROM events")
def m1_ihs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", F.round(stats.ihs(F.col("value"), 0.5), 6).alias("y"))


_DIST = "dist AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE) / list_sum(list_transform(embedding, lambda y: abs(y::DOUBLE)))) AS p FROM embeddings)"
SQL["dist"] = _DIST


@query("""SELECT vec_id, round(list_sum(list_transform(p, lambda x: CASE WHEN x = 0 THEN 0 ELSE x * (log2(x) - log2(1.0::DOUBLE / 64)) END)), 6) AS kl,
  round(0.5 * list_sum(list_transform(p, lambda x: CASE WHEN x = 0 THEN 0 ELSE x * (log2(x) - log2((x + 1.0::DOUBLE / 64) / 2)) END)) + 0.5 * list_sum(list_transform(p, lambda x: 1.0::DOUBLE / 64 * (log2(1.0::DOUBLE / 64) - log2((x + 1.0::DOUBLE / 64) / 2)))), 6) AS js FROM dist""", "dist")
def m2_divergences(spark: SparkSession, d: str) -> DataFrame:
    x = read_table(spark, d, "embeddings").withColumn("a", F.transform("embedding", lambda v: F.abs(v.cast("double"))))
    x = x.withColumn("t", F.aggregate("a", F.lit(0.0), lambda a, v: a + v)).withColumn("p", F.transform("a", lambda v: v / F.col("t")))
    q = F.transform("p", lambda v: F.lit(1 / 64))
    return x.select("vec_id", F.round(stats.kld(F.col("p"), q), 6).alias("kl"), F.round(stats.jsd(F.col("p"), q), 6).alias("js"))


_LONG = "long AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"
SQL["long"] = _LONG


def _long(spark: SparkSession, d: str) -> DataFrame:
    x = read_table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return x.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.col("x").cast("double").alias("x"))


@query("SELECT vec_id, pos, round(avg(x) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS mean FROM long", "long")
def w2_slide_average(spark: SparkSession, d: str) -> DataFrame:
    return stats.slide_average(_long(spark, d), "pos", "x", 3, ["vec_id"]).select("vec_id", "pos", F.round("mean", 6).alias("mean"))


@query("SELECT event_id, round((value - avg(value) OVER (PARTITION BY event_type)) / stddev_samp(value) OVER (PARTITION BY event_type), 6) AS scaled FROM events")
def w3_scale(spark: SparkSession, d: str) -> DataFrame:
    return stats.scale(read_table(spark, d, "events").select("event_id", "event_type", "value"), "value", ["event_type"]).select("event_id", F.round("scaled", 6).alias("scaled"))


@query("""SELECT vec_id, pos, round(avg(rm) OVER (PARTITION BY vec_id, x), 6) AS normalized FROM (SELECT *, avg(x) OVER (PARTITION BY rk) AS rm FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x, pos) AS rk FROM long))""", "long")
def w4_quantile_normalize(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantile_normalize(_long(spark, d), "pos", "vec_id", "x").select("vec_id", "pos", F.round("normalized", 6).alias("normalized"))


@query("""SELECT peak_id, rk AS rank FROM (SELECT *, max(CASE WHEN p <= rk * 0.2::DOUBLE / n THEN rk END) OVER () AS top FROM (SELECT peak_id, p, row_number() OVER (ORDER BY p, peak_id) AS rk, count(*) OVER () AS n FROM
  (SELECT peak_id, 1 / (1 + np_pvalue * np_pvalue) AS p FROM narrowpeak WHERE np_pvalue IS NOT NULL AND NOT isnan(np_pvalue)))) WHERE rk <= top""")
def m9_filter_fdr(spark: SparkSession, d: str) -> DataFrame:
    x = read_table(spark, d, "narrowpeak").select("peak_id", (1 / (1 + F.col("np_pvalue") * F.col("np_pvalue"))).alias("p"))
    return stats.filter_fdr(x, "p", 0.2, "peak_id").select("peak_id", "rank")


@query("""WITH v AS (SELECT value AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND abs(value) < 'inf'::DOUBLE), s AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd, (quantile_disc(v, 0.75) - quantile_disc(v, 0.25)) / 1.34 AS iqr FROM v),
 g AS (SELECT n, lo - (hi - lo) / 10 AS a, (hi - lo) * 1.2 / 511 AS step, 0.9 * least(sd, iqr) * pow(n, -0.2::DOUBLE) AS h FROM s), b AS (SELECT least(510, greatest(0, floor((v - a) / step)))::INTEGER AS i, (v - a) / step AS f FROM v, g),
 w AS (SELECT i, sum(w) AS w FROM (SELECT i, 1 - (f - i) AS w FROM b UNION ALL SELECT i + 1, f - i FROM b) GROUP BY i)
 SELECT round(a + k * step, 6) AS x, round(sum(w * exp(-0.5 * pow((k - i) * step / h, 2))) / (h * sqrt(2 * pi()) * n), 6) AS density FROM (SELECT unnest(range(512)) AS k), w, g GROUP BY k, a, step, h, n""")
def m5_density(spark: SparkSession, d: str) -> DataFrame:
    """Density of all event values at 512 points. The quartiles behind the bandwidth are the engine's approximate ones, exact up to a million rows."""
    return stats.density(read_table(spark, d, "events"), "value").select(F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


# --- annotation ----------------------------------------------------------------------------------
@query("""SELECT c_custkey::VARCHAR AS gene_id, count(DISTINCT o_orderkey) AS n_transcripts, coalesce(sum(n), 0)::BIGINT AS n_exons FROM customer LEFT JOIN orders ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, count(DISTINCT (l_partkey, l_partkey + (l_quantity * 10)::BIGINT)) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def a14_gene_models(spark: SparkSession, d: str) -> DataFrame:
    g = an.gene_models(dv.gene_elements(spark, d))
    return g.select("gene_id", F.size("transcripts").cast("bigint").alias("n_transcripts"), F.aggregate("transcripts", F.lit(0).cast("bigint"), lambda a, t: a + F.size(t["exons"])).alias("n_exons"))


SQL["proms"] = """proms AS (SELECT DISTINCT 'chr' || c_nationkey AS chrom, greatest(0, tss - CASE WHEN s THEN 500 ELSE 100 END) AS chrom_start, tss + CASE WHEN s THEN 100 ELSE 500 END AS chrom_end, tss, c_name AS gene_name FROM
  (SELECT *, c_acctbal >= 0 AS s, c_custkey * 2000 + CASE WHEN c_acctbal >= 0 THEN 0 ELSE 1500 END AS tss FROM customer UNION ALL
   SELECT customer.*, c_acctbal >= 0, CASE WHEN c_acctbal >= 0 THEN o_custkey * 2000 + o_orderkey % 700 ELSE o_custkey * 2000 + 800 + o_orderkey % 600 END FROM customer JOIN orders ON o_custkey = c_custkey))"""


def _promoters(spark: SparkSession, d: str) -> DataFrame:
    return an.promoters(an.gene_models(dv.gene_elements(spark, d)), 500, 100)


@query("SELECT * FROM proms", "proms")
def g5_promoters(spark: SparkSession, d: str) -> DataFrame:
    return _promoters(spark, d)


@query("""SELECT chrom, CASE side WHEN 1 THEN l ELSE chrom_end END AS chrom_start, CASE side WHEN 1 THEN chrom_start ELSE r END AS chrom_end, tss, gene_name FROM (SELECT *, unnest([1, 2]) AS side FROM
  (SELECT *, CASE WHEN le IS NULL THEN greatest(chrom_start - 100000, 0) ELSE least(chrom_start, greatest(chrom_start - 100000, le)) END AS l, CASE WHEN rs IS NULL THEN chrom_end + 100000 ELSE greatest(chrom_end, least(chrom_end + 100000, rs)) END AS r FROM
   (SELECT *, lag(chrom_end) OVER w AS le, lead(chrom_start) OVER w AS rs FROM proms WINDOW w AS (PARTITION BY chrom ORDER BY chrom_start, chrom_end, gene_name)))) WHERE CASE side WHEN 1 THEN l < chrom_start ELSE r > chrom_end END""", "proms")
def w5_regulatory_domains(spark: SparkSession, d: str) -> DataFrame:
    return an.regulatory_domains(_promoters(spark, d), 100_000, "gene_name")


@query("""SELECT start AS id, max(lvl)::INTEGER AS level FROM up GROUP BY start""")
def h1_go_levels(spark: SparkSession, d: str) -> DataFrame:
    return an.go_levels(read_table(spark, d, "part").select(F.col("p_partkey").alias("id")), dv.part_links(spark, d))


ORACLE["h1_go_levels"] = """WITH RECURSIVE up(start, cur, lvl) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION
  SELECT start, unnest([cur // 2, cur // 3]), lvl + 1 FROM up WHERE cur > 0) """ + ORACLE["h1_go_levels"]


@query("""SELECT start AS id, 'free' AS node_state, max(lvl)::INTEGER AS level FROM up GROUP BY start UNION ALL SELECT id, 'on_cycle', -1 FROM cyc UNION ALL SELECT id, 'below_cycle', -1 FROM below""")
def h1_go_term_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of the ontology's terms; those on or under cycles are reported."""
    links = read_table(spark, d, "go_subclass").select(F.col("obo_id").alias("child"), rf.reference_number(F.col("sub_class_of"), "_").alias("parent"))
    return an.term_levels(read_table(spark, d, "go").select(F.col("obo_id").alias("id")), links)


ORACLE["h1_go_term_levels"] = """WITH RECURSIVE t AS (SELECT DISTINCT obo_id AS id FROM go WHERE obo_id IS NOT NULL),
 l AS (SELECT DISTINCT obo_id AS c, try_cast(trim(regexp_extract(trim(sub_class_of), '([^_]*)$', 1)) AS BIGINT) AS p FROM go_subclass),
 k AS (SELECT c, p FROM l WHERE p IS NOT NULL AND c IN (SELECT id FROM t)),
 reach(a, b) AS (SELECT c, p FROM k UNION SELECT r.a, k.p FROM reach r JOIN k ON r.b = k.c),
 cyc AS (SELECT DISTINCT a AS id FROM reach WHERE a = b),
 below AS (SELECT DISTINCT a AS id FROM reach WHERE b IN (SELECT id FROM cyc) AND a NOT IN (SELECT id FROM cyc)),
 up(start, cur, lvl) AS (SELECT id, id, 0 FROM t WHERE id NOT IN (SELECT id FROM cyc) AND id NOT IN (SELECT id FROM below)
  UNION SELECT start, k.p, lvl + 1 FROM up JOIN k ON cur = k.c) """ + ORACLE["h1_go_term_levels"]


def _annotated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = read_table(spark, d, "gaf")
    a = g.where(F.trim("gaf_go_id") != "").select(F.col("gaf_db_id").alias("item"), F.trim("gaf_go_id").alias("term"))
    return a, g.where("gaf_aspect = 'P'").select(F.col("gaf_db_id").alias("item"))


@query("""SELECT term, count(f) AS x, count(*) AS m, (SELECT count(DISTINCT item) FROM a WHERE item IN (SELECT f FROM fg)) AS n, (SELECT count(DISTINCT item) FROM a) AS total FROM (SELECT DISTINCT item, term FROM a) LEFT JOIN fg ON item = f GROUP BY term HAVING count(f) > 0""", "annot")
def h2_enrichment_counts(spark: SparkSession, d: str) -> DataFrame:
    return an.enrichment(*_annotated(spark, d)).select("term", "x", "m", "n", "total")


@query("""SELECT term, x, m, n, total, round(x * total / (m * n)::DOUBLE, 6) AS fold_change, round(sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + lgamma(total - m + 1) - lgamma(n - k + 1) - lgamma(total - m - n + k + 1)
  - lgamma(total + 1) + lgamma(n + 1) + lgamma(total - n + 1))), 6) AS p_value FROM (SELECT *, unnest(range(x, least(m, n) + 1)) AS k FROM (SELECT term, count(f) AS x, count(*) AS m, (SELECT count(DISTINCT item) FROM a WHERE item IN (SELECT f FROM fg)) AS n,
  (SELECT count(DISTINCT item) FROM a) AS total FROM (SELECT DISTINCT item, term FROM a) LEFT JOIN fg ON item = f GROUP BY term HAVING count(f) > 0)) WHERE total - m - n + k >= 0 GROUP BY ALL""", "annot")
def h2_enrichment(spark: SparkSession, d: str) -> DataFrame:
    x = an.enrichment(*_annotated(spark, d))
    return x.select("term", "x", "m", "n", "total", F.round("fold_change", 6).alias("fold_change"), F.round("p_value", 6).alias("p_value"))


# --- contacts, codecs ----------------------------------------------------------------------------
def _contacts(spark: SparkSession, d: str) -> DataFrame:
    return hc.contact_map(dv.contact_pairs(spark, d))


@query("SELECT * FROM m", "cells")
def a22_contact_map(spark: SparkSession, d: str) -> DataFrame:
    return _contacts(spark, d)


@query("""SELECT m.i, m.j, round(CASE WHEN a.s * b.s = 0 THEN 0 ELSE value / (a.s / 1e6 * (b.s / 1e6)) END, 3) AS vc, round(CASE WHEN a.s * b.s = 0 THEN 0 ELSE value / sqrt(a.s / 1e6 * (b.s / 1e6)) END, 6) AS sq
  FROM m JOIN rs a ON a.i = m.i JOIN rs b ON b.i = m.j""", "cells", "rows")
def a24_coverage_norm(spark: SparkSession, d: str) -> DataFrame:
    m = materialize(_contacts(spark, d), "contacts")
    s = hc.coverage_norm(m, root=True).withColumnRenamed("value", "sq")
    return hc.coverage_norm(m).join(s, ["i", "j"]).select("i", "j", F.round("value", 3).alias("vc"), F.round("sq", 6).alias("sq"))


@query("""SELECT i, j, round(CASE WHEN e = 0 THEN 0 ELSE value / e END, 6) AS value FROM m JOIN (SELECT j - i AS d, sum(value)::DOUBLE / (300 - (j - i)) AS e FROM m GROUP BY j - i) ON d = j - i""", "cells")
def a25_observed_expected(spark: SparkSession, d: str) -> DataFrame:
    return hc.observed_over_expected(_contacts(spark, d), 300).select("i", "j", F.round("value", 6).alias("value"))


@query("""SELECT event_id, CASE WHEN value <= 5 THEN 0 WHEN value >= 60 THEN 9 ELSE trunc((value - 5) / ((60 - 5) / 10.0::DOUBLE))::INTEGER END AS colour FROM events""")
def v1_palette(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", hc.palette_index(F.col("value"), 5, 60, 10).alias("colour"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f7_json_path(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", formats.json_path(F.col("props"), "$.k", "bigint", strict=False).alias("k"))


@query("SELECT chrom, chrom_start, chrom_end, CASE WHEN bed_name <> '.' THEN bed_name END AS name, bed_score AS score, bed_strand AS strand FROM bed")
def s9_bed_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as lines and parsed again."""
    return codecs.decode(codecs.encode(dv.tags(spark, d), "bed"), "bed")


@query("SELECT chrom, chrom_start, chrom_end, bed_score::DOUBLE AS value FROM bed WHERE bed_score IS NOT NULL")
def s11_bedgraph_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Records with a value written as lines and parsed again."""
    x = dv.tags(spark, d).where("score IS NOT NULL").withColumn("value", F.col("score").cast("double"))
    return codecs.decode(codecs.encode(x, "bedgraph"), "bedgraph")


@query("SELECT doc_id, qual[1] AS first_symbol, length(qual) AS n, ascii(qual[1]) - 33 AS first_score, round(pow(10.0::DOUBLE, -(ascii(qual[1]) - 33) / 10.0::DOUBLE), 9) AS first_error FROM reads", "reads")
def f5_quality_scores(spark: SparkSession, d: str) -> DataFrame:
    x = dv.reads(spark, d).withColumn("q", sq.quality_scores(F.col("qual")))
    q = F.get("q", F.lit(0))
    return x.select("doc_id", F.substring("qual", 1, 1).alias("first_symbol"), F.size("q").cast("bigint").alias("n"), q.alias("first_score"), F.round(sq.error_probability(q), 9).alias("first_error"))


@query("""SELECT doc_id, length(qual) AS n, list_sum(list_transform(range(1, length(qual) + 1), lambda i: ascii(qual[i]) - 33))::BIGINT AS score_sum,
  round(list_sum(list_transform(range(1, length(qual) + 1), lambda i: pow(10.0::DOUBLE, -(ascii(qual[i]) - 33) / 10.0::DOUBLE))), 6) AS error_sum FROM reads""", "reads")
def f5_quality_sums(spark: SparkSession, d: str) -> DataFrame:
    """Scores and error probabilities of all symbols of each read, summed."""
    x = dv.reads(spark, d).withColumn("q", sq.quality_scores(F.col("qual")))
    return x.select("doc_id", F.size("q").cast("bigint").alias("n"), F.aggregate("q", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("score_sum"),
        F.round(F.aggregate("q", F.lit(0.0), lambda a, v: a + sq.error_probability(v)), 6).alias("error_sum"))
