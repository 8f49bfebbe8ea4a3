"""Queries of column functions and small kernels, over whole tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.functions import sequence as sq, stats
from helixframe.operators import annotation as an, contacts as hc, intervals as iv, reads as rd
from helixframe.plans import derive as dv
from helixframe.plans.derive import SQL
from helixframe.plans.genomics import _promoters, query as _register
from helixframe.runtime import read_table
from helixframe.sources import formats

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *parts: str):
    return _register(sql, *parts, queries=QUERIES, oracle=ORACLE)


# --- intervals -----------------------------------------------------------------------------------
@query("SELECT rec_id, chrom_end - chrom_start AS size, chrom = 'chr1' AND chrom_end > 1000000 AND chrom_start < 2000000 AS near, CASE WHEN chrom = 'chr1' THEN greatest(0, least(chrom_end - 1000000, 2000000 - chrom_start, chrom_end - chrom_start, 1000000)) ELSE 0 END AS shared FROM tags", "tags")
def iv_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Size, and overlap with one stretch of chr1 (P1, P4, P5)."""
    c, s, e = F.col("chrom"), F.col("chrom_start"), F.col("chrom_end")
    one = (F.lit("chr1"), F.lit(1_000_000), F.lit(2_000_000))
    return dv.tags(spark, d).select("rec_id", iv.size().alias("size"), iv.is_overlapped(c, s, e, *one).alias("near"), iv.size_overlapped(c, s, e, *one).alias("shared"))


@query("SELECT np_chrom AS chrom, np_start AS chrom_start, np_end AS chrom_end, NULL::VARCHAR AS name, NULL::INTEGER AS score, np_strand AS strand, peak_id AS region_id FROM narrowpeak")
def iv_as_bed(spark: SparkSession, d: str) -> DataFrame:
    """Peaks as BED6: what they do not have is NULL, what they have more can be kept (P2, P3)."""
    return iv.as_bed(dv.peaks(spark, d), ["region_id"])


@query("SELECT rec_id, md5(CASE WHEN length(s) - length(rtrim(s, 'A')) >= 3 THEN rtrim(s, 'A') ELSE s END) AS seq_md5, length(CASE WHEN length(s) - length(rtrim(s, 'A')) >= 3 THEN rtrim(s, 'A') ELSE s END) AS n_qual FROM (SELECT rec_id, repeat('ACG', (rec_id % 9)::INTEGER) || repeat('A', (rec_id % 6)::INTEGER) AS s FROM bed)")
def f8_trim_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads with their trailing run of A cut from sequence and quality."""
    s = F.concat(F.repeat(F.lit("ACG"), (F.col("rec_id") % 9).cast("int")), F.repeat(F.lit("A"), (F.col("rec_id") % 6).cast("int")))
    x = rd.trim_poly_a(dv.tags(spark, d).select("rec_id", s.alias("seq"), F.repeat(F.lit("I"), F.length(s)).alias("qual")), 3)
    return x.select("rec_id", F.md5("seq").alias("seq_md5"), F.length("qual").cast("bigint").alias("n_qual"))


# --- sequences -----------------------------------------------------------------------------------
SQL["iupac"] = "iupac AS (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^ACGTNVHDBMKWSYRacgtnvhdbmkwsyr]', '', 'g')) AS seq FROM documents)"


def _iupac(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTNVHDBMKWSYRacgtnvhdbmkwsyr]", "")).alias("seq"))


_N = "(length(seq) - length(translate(seq, '{}', '')))"


@query(f"""SELECT doc_id, CASE WHEN seq = '' THEN 'nan'::DOUBLE ELSE round(({_N.format('CGS')} + 0.75 * {_N.format('VB')} + 0.5 * {_N.format('NMKYR')} + 0.25 * {_N.format('HD')}) / length(seq), 9) END AS gc,
  md5(reverse(translate(seq, 'ACGTVHDBMKWSYR', 'TGCABDHVKMWSRY'))) AS rc_md5 FROM iupac""", "iupac")
def f2_iupac_gc(spark: SparkSession, d: str) -> DataFrame:
    """GC content and reverse complement of sequences with ambiguous letters."""
    return _iupac(spark, d).select("doc_id", F.round(sq.gc_content(F.col("seq")), 9).alias("gc"), F.md5(sq.reverse_complement(F.col("seq"), iupac=True)).alias("rc_md5"))


@query("SELECT doc_id, substr(seq, 4, 20) AS part, length(seq || 'ACGT') AS n, CASE WHEN translate(seq, 'ACGT', '') <> '' THEN translate(seq, 'ACGT', '')[1] END AS first_other FROM iupac", "iupac")
def f4_slices(spark: SparkSession, d: str) -> DataFrame:
    """Twenty letters after the first three, the length of a concatenation, and the first letter that is no base."""
    s = F.col("seq")
    return _iupac(spark, d).select("doc_id", sq.slice_seq(s, 3, 20).alias("part"), F.length(F.concat(s, F.lit("ACGT"))).cast("bigint").alias("n"), sq.invalid_letter(s).alias("first_other"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def f7_json_strict(spark: SparkSession, d: str) -> DataFrame:
    """A value that must be there."""
    x = read_table(spark, d, "events").where(formats.json_path(F.col("props"), "$.k", strict=False).isNotNull())
    return x.select("event_id", formats.json_path(F.col("props"), "$.k").alias("k"))


# --- statistics ----------------------------------------------------------------------------------
@query("SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value <= 0 THEN 0 ELSE least(400, ceil(value / 0.25))::BIGINT END AS at FROM events")
def w6_lower_bound(spark: SparkSession, d: str) -> DataFrame:
    """Place of each value in a sorted grid of 400 numbers, a quarter apart."""
    grid = np.arange(400) * 0.25

    @F.pandas_udf("bigint")
    def at(v):
        return v.map(lambda x: int(stats.lower_bound(grid, x)), na_action="ignore").astype("Int64")

    return read_table(spark, d, "events").select("event_id", at("value").alias("at"))


_KINDS = {"linear": "g", "quadratic": "g * g", "cubic": "g * g * g", "exp": "pow(2.0::DOUBLE, g) - 1"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, g, m, round(({e}) * 0.05::DOUBLE / m, 9) AS penalty FROM (SELECT DISTINCT l_linenumber - 1 AS g, l_quantity::INTEGER AS m FROM lineitem WHERE l_quantity >= 1)" for k, e in _KINDS.items()))
def m6_gap_penalties(spark: SparkSession, d: str) -> DataFrame:
    """All four penalties over the pairs of line numbers and quantities."""
    fns = {k: stats.gap_penalty(k, 0.05) for k in _KINDS}
    x = read_table(spark, d, "lineitem").where("l_quantity >= 1").select((F.col("l_linenumber") - 1).alias("g"), F.col("l_quantity").cast("int").alias("m")).distinct()

    def run(batches):
        for b in batches:
            rows = [(k, g, m, round(float(f(g, m)), 9)) for g, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, f in fns.items()]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["kind", "g", "m", "penalty"])

    return x.mapInArrow(run, "kind string, g int, m int, penalty double")


@query("""SELECT vec_id, round(list_avg(a), 6) AS l1, round(sqrt(list_avg(list_transform(a, lambda x: x * x))), 6) AS l2, round(pow(list_avg(list_transform(a, lambda x: x * x * x)), 1 / 3.0::DOUBLE), 6) AS l3, round(list_max(a), 6) AS "max"
  FROM (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings)""")
def m7_norms(spark: SparkSession, d: str) -> DataFrame:
    """The four ways to combine distances, over the sizes of the embeddings' numbers."""
    def run(batches):
        for b in batches:
            v = [np.abs(np.array(e, dtype=float)) for e in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([f(x) for x in v], pa.float64()) for f in stats.COMBINE.values()]], names=["vec_id", *stats.COMBINE])

    x = read_table(spark, d, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, " + ", ".join(f"{k} double" for k in stats.COMBINE))
    return x.select("vec_id", *[F.round(k, 6).alias(k) for k in stats.COMBINE])


@query("SELECT vec_id, list_count(list_filter(b, lambda x: x))::BIGINT AS n_set, array_to_string(list_transform(b, lambda x: CASE WHEN x THEN '1' ELSE '0' END), '') AS bits FROM (SELECT vec_id, list_transform(range(64), lambda i: embedding[i + 1] > 0 AND i % 5 <> 0) AS b FROM embeddings)")
def m8_bit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Bits of positive numbers; every fifth is cleared again."""
    def bits(e):
        v = stats.BitVector(len(e))
        for i, x in enumerate(e):
            if x > 0:
                v.set(i)
        for i in range(0, len(v), 5):
            v.clear(i)
        return sum(v[i] for i in range(len(v))), "".join("01"[x] for x in v.tolist())

    def run(batches):
        for b in batches:
            r = [bits(e) for e in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in r], pa.int64()), pa.array([x[1] for x in r], pa.string())], names=["vec_id", "n_set", "bits"])

    return read_table(spark, d, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, n_set bigint, bits string")


# --- annotation, contacts ------------------------------------------------------------------------
@query("""SELECT chrom, CASE side WHEN 1 THEN l ELSE chrom_end END AS chrom_start, CASE side WHEN 1 THEN chrom_start ELSE r END AS chrom_end, tss, gene_name FROM (SELECT *, unnest([1, 2]) AS side FROM
  (SELECT *, CASE WHEN le IS NULL THEN greatest(chrom_start - 100000, 0) ELSE least(chrom_start, greatest(chrom_start - 100000, le)) END AS l, CASE WHEN rs IS NULL THEN chrom_end + 100000 ELSE greatest(chrom_end, least(chrom_end + 100000, rs)) END AS r FROM
   (SELECT *, lag(chrom_end) OVER w AS le, lead(chrom_start) OVER w AS rs, row_number() OVER (ORDER BY chrom, chrom_start, chrom_end, gene_name) AS k FROM proms WINDOW w AS (PARTITION BY chrom ORDER BY chrom_start, chrom_end, gene_name)) WHERE (k - 1) % 3 = 0))
  WHERE CASE side WHEN 1 THEN l < chrom_start ELSE r > chrom_end END""", "proms")
def w5_every_third(spark: SparkSession, d: str) -> DataFrame:
    """Domains as the older interface returned them: of every third promoter."""
    return an.regulatory_domains(_promoters(spark, d), 100_000, "gene_name", every_third=True)


@query("SELECT i, j, arg_max(value, event_id) AS value FROM (SELECT least(user_id % 40, event_id % 30) AS i, greatest(user_id % 40, event_id % 30) AS j, value, event_id FROM events WHERE value IS NOT NULL) GROUP BY ALL")
def a21_cells_from_list(spark: SparkSession, d: str) -> DataFrame:
    """Symmetric cells; of those given twice the last counts."""
    e = read_table(spark, d, "events").where("value IS NOT NULL")
    return hc.from_list(e.select((F.col("user_id") % 40).alias("i"), (F.col("event_id") % 30).alias("j"), "value", "event_id"), "event_id")


@query("SELECT i, j, CASE WHEN i = j THEN n // 2 ELSE n END AS value FROM cells", "cells")
def a23_contact_map_diagonal(spark: SparkSession, d: str) -> DataFrame:
    return hc.contact_map(dv.contact_pairs(spark, d), halve="diagonal")


SQL["mate_bins"] = """mate_bins AS (SELECT (CASE WHEN o_custkey % 2 = 0 THEN o_orderkey % 90000 + 36 ELSE o_orderkey % 90000 END) // 1000 AS a, (CASE WHEN o_custkey % 3 = 0 THEN o_custkey * 37 % 90000 + 36 ELSE o_custkey * 37 % 90000 END) // 1000 AS b FROM orders)"""


@query("SELECT least(a, b) AS i, greatest(a, b) AS j, count(*) // 2 AS value FROM mate_bins GROUP BY ALL", "mate_bins")
def a22_read_pair_bins(spark: SparkSession, d: str) -> DataFrame:
    """Contacts of read pairs, binned at their 5' ends."""
    o = read_table(spark, d, "orders")
    a = hc.bin_of(F.col("o_orderkey") % 90000, F.col("o_custkey") % 2 == 0, F.lit(36), 1000)
    b = hc.bin_of(F.col("o_custkey") * 37 % 90000, F.col("o_custkey") % 3 == 0, F.lit(36), 1000)
    return hc.contact_map(o.select(a.alias("bin1"), b.alias("bin2")))


@query("SELECT region_id, CASE WHEN any_value(p.chrom_end - p.chrom_start) = 0 THEN NULL ELSE coalesce(sum(t.score * (t.chrom_end - t.chrom_start)), 0)::DOUBLE / any_value(p.chrom_end - p.chrom_start) END AS score FROM peaks p LEFT JOIN tags t ON t.chrom = p.chrom AND t.chrom_start < p.chrom_end AND p.chrom_start < t.chrom_end AND t.chrom_end > t.chrom_start AND p.chrom_end > p.chrom_start GROUP BY region_id", "tags", "peaks")
def s41_mean_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a graph table per region, divided by the region's size (S41, A20)."""
    from helixframe.operators import counting as ct

    return ct.interval_scores(dv.peaks(spark, d), dv.tags(spark, d).select(*iv.BED3, F.col("score").cast("double").alias("value")), normalize=True)
