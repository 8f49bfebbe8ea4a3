"""Queries of the data-quality problems that belong to the core, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.operators import hierarchy as hi, packed, periods, references as rf, reject, skew
from helixframe.runtime import read_table
from helixframe.sources.formats import GAF_COLUMNS

PACKED_FIELDS = ["gaf_db_ref", "gaf_with_or_from", "gaf_synonym", "gaf_taxon"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return reject.parse_lines(read_table(spark, d, "raw_lines")).where("reason IS NOT NULL").select("line_id", "reason")


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The readable bed and narrowPeak lines as typed rows."""
    return reject.load_intervals(reject.parse_lines(read_table(spark, d, "raw_lines")))


def p1_loaded_gaf(spark: SparkSession, d: str) -> DataFrame:
    """The readable GAF lines as typed rows."""
    return reject.load_annotations(reject.parse_lines(read_table(spark, d, "raw_lines")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.dominant_keys(read_table(spark, d, "bed"), "chrom", 25, 1000)


def p3_per_chrom(spark: SparkSession, d: str) -> DataFrame:
    """Rows and covered bases per chrom by the split plan."""
    size = F.col("chrom_end") - F.col("chrom_start")
    x = skew.aggregate_by_key(read_table(spark, d, "bed").select("chrom", "chrom_start", "chrom_end"), "chrom", {
        "n": (F.count(F.lit(1)), F.sum("n")), "bases": (F.sum(size), F.sum("bases")), "first_start": (F.min("chrom_start"), F.min("first_start"))})
    return x.select("chrom", "n", "bases", "first_start")


def p3_join_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Records per track and assay: a join whose left side is dominated by a few tracks."""
    x = skew.join_by_key(read_table(spark, d, "bed").select("track_id", "chrom"), read_table(spark, d, "tracks").select("track_id", "assay"), "track_id", how="left")
    return x.groupBy("track_id", "assay").agg(F.count(F.lit(1)).alias("n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return periods.periods_and_gaps(read_table(spark, d, "bed"), ["track_id", "chrom"], "chrom_start", "chrom_end")


def _references(spark: SparkSession, d: str) -> DataFrame:
    gaf = read_table(spark, d, "gaf").select(F.lit("gaf").alias("table_name"), F.col("gaf_id").alias("row_id"), rf.reference_number(F.col("gaf_go_id"), ":").alias("ref_id"),
        F.coalesce(F.try_to_timestamp("gaf_date", F.lit("yyyyMMdd")), F.try_to_timestamp("gaf_date", F.lit("yyyy-MM-dd"))).alias("ref_at"))
    sub = read_table(spark, d, "go_subclass").select(F.lit("go_subclass").alias("table_name"), F.col("edge_id").alias("row_id"), rf.reference_number(F.col("sub_class_of"), "_").alias("ref_id"), F.to_date("asserted_at").cast("timestamp").alias("ref_at"))
    return gaf.union(sub)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Dates are compared: a term made or deprecated on the day of the reference counts by its date."""
    go = read_table(spark, d, "go").select("obo_id", F.to_date("created_at").alias("c"), F.to_date("deprecated_at").alias("x"))
    return rf.orphan_references(_references(spark, d), rf.parent_validity(go, "obo_id", "c", "x"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, kind and month."""
    return p5_found(spark, d).groupBy("table_name", "ref_kind", "ref_month").agg(F.count(F.lit(1)).alias("n"))


def _ontology(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    links = read_table(spark, d, "go_subclass").select(F.col("obo_id").alias("child"), rf.reference_number(F.col("sub_class_of"), "_").alias("parent"))
    return read_table(spark, d, "go").select(F.col("obo_id").alias("id")), links


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hi.hierarchy(*_ontology(spark, d)).withColumnRenamed("id", "obo_id")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Number of distinct descendants of each term that has any, off all cycles."""
    return hi.descendant_counts(*_ontology(spark, d)).withColumnRenamed("id", "obo_id")


def p6_descendant_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every term with each of its descendants, off all cycles."""
    return hi.descendants(*_ontology(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.explode_packed(read_table(spark, d, "gaf"), "gaf_id", PACKED_FIELDS, min_values=2)


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p1_loaded_gaf, p3_found, p3_per_chrom, p3_join_tracks, p4_found, p5_found, p5_report, p6_found, p6_descendants, p6_descendant_pairs, p7_found)}

_FIELD = r'''(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'''
_LINES = rf"""
 raw AS (SELECT line_id, fmt, regexp_replace(coalesce(line, ''), '\r$', '') AS t FROM raw_lines),
 rec AS (SELECT * FROM raw WHERE t <> '' AND NOT regexp_matches(t, '^(?:[#!]|(?:track|browser)\s)')),
 tok AS (SELECT *, regexp_full_match(t, '{_FIELD}(?:\t{_FIELD})*') AS ok,
   list_transform(regexp_extract_all(chr(9) || t, '\t({_FIELD})', 1), lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:length(x)-1], '""', '"') ELSE x END) AS f FROM rec),
 val AS (SELECT *, len(f) AS n,
   NOT coalesce(regexp_full_match(f[2], '[0-9]+') AND regexp_full_match(f[3], '[0-9]+') AND try_cast(f[2] AS BIGINT) <= try_cast(f[3] AS BIGINT), false) AS badpos FROM tok),
 res AS (SELECT *, CASE WHEN NOT ok THEN 'quoting'
   WHEN fmt = 'bed' AND n < 3 OR fmt = 'narrowpeak' AND n <> 3 AND n < 10 OR fmt = 'gaf' AND n <> 17 THEN 'columns'
   WHEN fmt IN ('bed', 'narrowpeak') AND badpos THEN 'value'
   WHEN fmt = 'narrowpeak' AND n >= 10 AND NOT regexp_full_match(f[8], '[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?') THEN 'value'
   WHEN fmt = 'gaf' AND NOT regexp_full_match(f[5], 'GO:[0-9]{{7}}') THEN 'value' END AS reason FROM val)"""

_LINKS = """
 t AS (SELECT DISTINCT obo_id AS id FROM go WHERE obo_id IS NOT NULL),
 l AS (SELECT DISTINCT obo_id AS c, try_cast(trim(regexp_extract(trim(sub_class_of), '([^_]*)$', 1)) AS BIGINT) AS p FROM go_subclass),
 k AS (SELECT c, p FROM l WHERE p IN (SELECT id FROM t) AND c IN (SELECT id FROM t)),
 reach(a, b) AS (SELECT c, p FROM k UNION SELECT r.a, k.p FROM reach r JOIN k ON r.b = k.c),
 cyc AS (SELECT DISTINCT a AS id FROM reach WHERE a = b)"""
_PATHS = _LINKS + """,
 path(id, root, lvl, full_path) AS (
   SELECT id, id, 0, id::VARCHAR FROM t WHERE id NOT IN (SELECT c FROM k)
   UNION ALL SELECT k.c, root, lvl + 1, full_path || '/' || k.c FROM path JOIN k ON k.p = path.id WHERE k.c NOT IN (SELECT id FROM cyc))"""

_P5 = """
 refs AS (SELECT 'gaf' AS table_name, gaf_id AS row_id, try_cast(trim(regexp_extract(trim(gaf_go_id), '([^:]*)$', 1)) AS BIGINT) AS ref_id, coalesce(try_strptime(gaf_date, '%Y%m%d'), try_strptime(gaf_date, '%Y-%m-%d'))::DATE AS d FROM gaf
   UNION ALL SELECT 'go_subclass', edge_id, try_cast(trim(regexp_extract(trim(sub_class_of), '([^_]*)$', 1)) AS BIGINT), asserted_at::DATE FROM go_subclass),
 par AS (SELECT obo_id, min(created_at)::DATE AS b, CASE WHEN count(deprecated_at) = count(*) THEN max(deprecated_at)::DATE END AS e FROM go GROUP BY obo_id),
 orph AS (SELECT table_name, row_id, ref_id, CASE WHEN obo_id IS NULL THEN 'missing' WHEN b > d THEN 'late' WHEN e <= d THEN 'deleted' END AS ref_kind, strftime(d, '%Y-%m') AS ref_month FROM refs LEFT JOIN par ON ref_id = obo_id WHERE ref_id IS NOT NULL)"""

_P4 = """
 b AS (SELECT rec_id, track_id, chrom, chrom_start AS s, chrom_end AS e FROM bed WHERE chrom_end > chrom_start),
 m AS (SELECT *, max(e) OVER (PARTITION BY track_id, chrom ORDER BY s, e, rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM b),
 g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, chrom ORDER BY s, e, rec_id ROWS UNBOUNDED PRECEDING) AS i FROM m),
 p AS (SELECT track_id, chrom, min(s) AS s, max(e) AS e FROM g GROUP BY track_id, chrom, i),
 q AS (SELECT *, lead(s) OVER (PARTITION BY track_id, chrom ORDER BY s) AS ns FROM p)"""

_VALUE = r'''(?:"(?:[^"]|"")*"[^|;,\t]*|[^|;,\t]*)'''
_P7 = " UNION ALL ".join(
    f"SELECT gaf_id, '{f}' AS field_name, regexp_extract_all('|' || {f}, '[|;,\\t] *({_VALUE})', 1) AS raw FROM gaf WHERE {f} IS NOT NULL" for f in PACKED_FIELDS)

_GAF = ", ".join(
    f"list_filter(string_split(f[{i}], '|'), lambda x: x <> '') AS {c}" if c in ("qualifier", "db_ref", "with_or_from", "synonym", "taxon", "annotation_extension") else f"nullif(f[{i}], '') AS {c}" for i, c in enumerate(GAF_COLUMNS, 1))

ORACLE = {
    "p1_found": f"WITH {_LINES} SELECT line_id, reason FROM res WHERE reason IS NOT NULL",
    "p1_loaded": f"""WITH {_LINES} SELECT line_id, fmt, f[1] AS chrom, f[2]::BIGINT AS chrom_start, f[3]::BIGINT AS chrom_end,
      CASE WHEN f[4] <> '.' THEN f[4] END AS name, try_cast(f[5] AS INTEGER) AS score, CASE f[6] WHEN '+' THEN true WHEN '-' THEN false END AS strand,
      CASE WHEN np THEN try_cast(f[7] AS DOUBLE) END AS signal, CASE WHEN np AND try_cast(f[8] AS DOUBLE) >= 0 THEN try_cast(f[8] AS DOUBLE) END AS pvalue,
      CASE WHEN np AND try_cast(f[9] AS DOUBLE) >= 0 THEN try_cast(f[9] AS DOUBLE) END AS qvalue, CASE WHEN np THEN try_cast(f[10] AS INTEGER) END AS peak
      FROM (SELECT *, fmt = 'narrowpeak' AND n >= 10 AS np FROM res) WHERE reason IS NULL AND fmt IN ('bed', 'narrowpeak')""",
    "p1_loaded_gaf": f"WITH {_LINES} SELECT line_id, fmt, {_GAF}, substr(f[5], 4)::BIGINT AS go_number FROM res WHERE reason IS NULL AND fmt = 'gaf'",
    "p3_found": "SELECT chrom FROM bed WHERE chrom IS NOT NULL GROUP BY chrom HAVING count(*) * 1000 >= 25 * (SELECT count(*) FROM bed)",
    "p3_per_chrom": "SELECT chrom, count(*) AS n, sum(chrom_end - chrom_start)::BIGINT AS bases, min(chrom_start) AS first_start FROM bed GROUP BY chrom",
    "p3_join_tracks": "SELECT track_id, assay, count(*) AS n FROM bed LEFT JOIN tracks USING (track_id) GROUP BY ALL",
    "p4_found": f"WITH {_P4} SELECT track_id, chrom, 'period' AS span_kind, s AS span_start, e AS span_end FROM p UNION ALL SELECT track_id, chrom, 'gap', e, ns FROM q WHERE ns IS NOT NULL",
    "p5_found": f"WITH {_P5} SELECT * FROM orph WHERE ref_kind IS NOT NULL",
    "p5_report": f"WITH {_P5} SELECT table_name, ref_kind, ref_month, count(*) AS n FROM orph WHERE ref_kind IS NOT NULL GROUP BY ALL",
    "p6_found": f"""WITH RECURSIVE {_PATHS}
      SELECT id AS obo_id, 'tree' AS node_state, root AS root_id, lvl, full_path FROM path
      UNION ALL SELECT id, 'on_cycle', -1, -1, '' FROM cyc
      UNION ALL SELECT id, 'below_cycle', -1, -1, '' FROM t WHERE id NOT IN (SELECT id FROM cyc) AND id NOT IN (SELECT id FROM path)""",
    "p6_descendants": f"""WITH RECURSIVE {_PATHS}, pairs AS (SELECT DISTINCT id, unnest(string_split(full_path, '/'))::BIGINT AS a FROM path)
      SELECT a AS obo_id, count(*) AS n_descendants FROM pairs WHERE a <> id GROUP BY a""",
    "p6_descendant_pairs": f"""WITH RECURSIVE {_PATHS}, pairs AS (SELECT DISTINCT id, unnest(string_split(full_path, '/'))::BIGINT AS a FROM path)
      SELECT a AS ancestor, id FROM pairs WHERE a <> id""",
    "p7_found": f"""WITH r AS ({_P7}), v AS (SELECT gaf_id, field_name, list_filter(list_transform(raw, lambda x:
        CASE WHEN regexp_matches(x, '^"(?:[^"]|"")*"') THEN replace(regexp_extract(x, '^"((?:[^"]|"")*)"', 1), '""', '"') ELSE trim(x) END), lambda x: x <> '') AS vals FROM r)
      SELECT gaf_id, field_name, unnest(range(1, len(vals) + 1))::INTEGER AS pos, unnest(vals) AS val FROM v WHERE len(vals) >= 2""",
}
