"""Queries of matrices, motif scans and alignment, each beside SQL that starts from the letters and not from our tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.motif import align as al, pwm, scan
from helixframe.plans import derive as dv
from helixframe.plans.derive import MOTIFS, SQL
from helixframe.plans.files import FAVOURED, gene_rows
from helixframe.plans.genomics import query as _register
from helixframe.operators import annotation as an
from helixframe.runtime import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *parts: str):
    return _register(sql, *parts, queries=QUERIES, oracle=ORACLE)


# --- matrices made from the embeddings: 16 rows of shares -----------------------------------------
SQL["cells16"] = """cell AS (SELECT vec_id, pos // 4 AS r, pos % 4 AS b, a / sum(a) OVER (PARTITION BY vec_id, pos // 4) AS p FROM (SELECT vec_id, unnest(range(64)) AS pos, abs(unnest(embedding)::DOUBLE) + 0.001::DOUBLE AS a FROM embeddings))"""


def _matrices(spark: SparkSession, d: str, run, schema: str) -> DataFrame:
    """``run(matrix, vec_id)`` gives the rows of each embedding's matrix."""

    def go(batches):
        for b in batches:
            out = []
            for k, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = np.abs(np.array(e, dtype=float)).reshape(16, 4) + 0.001
                out += [(k, *x) for x in run(a / a.sum(1, keepdims=True), k)]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    x = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    full = f"vec_id bigint, {schema}"
    fields = spark.createDataFrame([], full).schema
    names, kinds = fields.names, [to_arrow_type(f.dataType) for f in fields]
    return x.mapInArrow(go, full)


@query("""SELECT vec_id, round(sum(CASE WHEN b IN (1, 2) THEN p END) / 16, 6) AS gc, round(sum(p * (15 - r + 1) * (3 - b + 1)), 6) AS mirrored, round(sum(CASE WHEN r BETWEEN 3 AND 7 THEN p * (r - 3 + 1) * (b + 1) END), 6) AS part FROM cell GROUP BY vec_id""", "cells16")
def t1_matrix_views(spark: SparkSession, d: str) -> DataFrame:
    """GC share, and weighted sums over the reverse complement and over five rows."""
    def run(m, k):
        w = lambda x: float((x * np.arange(1, len(x) + 1)[:, None] * np.arange(1, 5)).sum())
        return [(pwm.gc_content(m), w(pwm.reverse_complement(m)), w(pwm.sub_matrix(m, 3, 5)))]

    x = _matrices(spark, d, run, "gc double, mirrored double, part double")
    return x.select("vec_id", *[F.round(c, 6).alias(c) for c in ("gc", "mirrored", "part")])


@query("""SELECT vec_id, string_agg(CASE WHEN p1 > 0.5 AND p1 > 2 * p2 THEN 'ACGT'[b1 + 1] WHEN p1 + p2 > 0.75 THEN CASE least(b1, b2) * 4 + greatest(b1, b2) WHEN 1 THEN 'M' WHEN 2 THEN 'R' WHEN 3 THEN 'W' WHEN 6 THEN 'S' WHEN 7 THEN 'Y' WHEN 11 THEN 'K' END ELSE 'N' END, '' ORDER BY r) AS consensus
  FROM (SELECT vec_id, r, max(p) FILTER (k = 1) AS p1, max(b) FILTER (k = 1) AS b1, max(p) FILTER (k = 2) AS p2, max(b) FILTER (k = 2) AS b2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, r ORDER BY p DESC, b) AS k FROM cell) GROUP BY vec_id, r) GROUP BY vec_id""", "cells16")
def t3_consensus(spark: SparkSession, d: str) -> DataFrame:
    return _matrices(spark, d, lambda m, k: [(pwm.consensus(m),)], "consensus string")


@query("SELECT vec_id, round(sum(best), 6) AS optimal, round(sum(best) FILTER (r > 9), 6) AS after_nine FROM (SELECT vec_id, r, ln(max(p) / 0.25) AS best FROM cell GROUP BY vec_id, r) GROUP BY vec_id", "cells16")
def t5_optimal_scores(spark: SparkSession, d: str) -> DataFrame:
    """The best score, and the best still to be had after row 9."""
    x = _matrices(spark, d, lambda m, k: [(pwm.optimal_score(m), float(pwm.optimal_suffix_scores(m)[9]))], "optimal double, after_nine double")
    return x.select("vec_id", F.round("optimal", 6).alias("optimal"), F.round("after_nine", 6).alias("after_nine"))


#: A word of all letters, and what each stands for.
_WORD = "ACGTNVHDBMKWSYRA"
SQL["letters"] = "letters AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {['ACGT'.index(c) for c in v]})" for k, v in pwm.IUPAC.items()) + ") v(letter, bases))"


@query(f"""SELECT vec_id, round(sum(ln(s / (len(bases) * 0.25))), 6) AS score FROM (SELECT vec_id, r, bases, sum(p) AS s FROM cell JOIN letters ON letter = '{_WORD}'[r + 1] WHERE list_contains(bases, b) GROUP BY ALL) GROUP BY vec_id""", "cells16", "letters")
def t4_score_word(spark: SparkSession, d: str) -> DataFrame:
    """Score of one word with every letter; N adds nothing."""
    return _matrices(spark, d, lambda m, k: [(pwm.score(m, _WORD),)], "score double").select("vec_id", F.round("score", 6).alias("score"))


@query("""SELECT vec_id, coalesce(min(r) FILTER (kl >= 0.6), -1)::INTEGER AS first_row, coalesce(max(r) FILTER (kl >= 0.6) - min(r) FILTER (kl >= 0.6) + 1, 0)::INTEGER AS n_rows FROM
  (SELECT vec_id, r, sum(p * log2(p / 0.25)) AS kl FROM cell GROUP BY vec_id, r) GROUP BY vec_id""", "cells16")
def t22_trim(spark: SparkSession, d: str) -> DataFrame:
    """Where the trimmed matrix begins, and its rows."""
    def run(m, k):
        t = pwm.trim(m, 0.6)
        return [(next((i for i in range(16) if len(t) and np.array_equal(m[i], t[0])), -1), len(t))]

    return _matrices(spark, d, run, "first_row int, n_rows int")


@query("""SELECT vec_id, (r - lo)::INTEGER AS r, b::INTEGER AS b, round(avg(p), 6) AS p FROM (SELECT vec_id, r, b, p, least(0, vec_id % 7 - 3) AS lo FROM cell UNION ALL SELECT vec_id, 15 - r + vec_id % 7 - 3, 3 - b, p, least(0, vec_id % 7 - 3) FROM cell) GROUP BY ALL""", "cells16")
def t20_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each matrix merged with its reverse complement at shifts from -3 to 3."""
    run = lambda m, k: [(r, b, float(v)) for r, row in enumerate(al.merge(m, pwm.reverse_complement(m), k % 7 - 3)) for b, v in enumerate(row)]
    return _matrices(spark, d, run, "r int, b int, p double").select("vec_id", "r", "b", F.round("p", 6).alias("p"))


@query("""SELECT vec_id, (r - lo)::INTEGER AS r, b::INTEGER AS b, round(sum(w * p) / sum(w), 6) AS p, sum(w)::INTEGER AS weight FROM (SELECT vec_id, r, b, p, 2 AS w, least(0, vec_id % 7 - 3) AS lo FROM cell UNION ALL SELECT vec_id, 15 - r + vec_id % 7 - 3, 3 - b, p, 5, least(0, vec_id % 7 - 3) FROM cell) GROUP BY ALL""", "cells16")
def t20_merge_weighted(spark: SparkSession, d: str) -> DataFrame:
    def run(m, k):
        x, w = al.merge_weighted(m, [2] * 16, pwm.reverse_complement(m), [5] * 16, k % 7 - 3)
        return [(r, b, float(v), w[r]) for r, row in enumerate(x) for b, v in enumerate(row)]

    return _matrices(spark, d, run, "r int, b int, p double, weight int").select("vec_id", "r", "b", F.round("p", 6).alias("p"), "weight")


@query("SELECT vec_id, r::INTEGER AS r, b::INTEGER AS b, round(((r % 4 + 1) * p + 0.25 * (4 - (r % 4 + 1))) / 4, 6) AS p FROM cell", "cells16")
def t21_dilute(spark: SparkSession, d: str) -> DataFrame:
    run = lambda m, k: [(r, b, float(v)) for r, row in enumerate(al.dilute(m, [i % 4 + 1 for i in range(16)])) for b, v in enumerate(row)]
    return _matrices(spark, d, run, "r int, b int, p double").select("vec_id", "r", "b", F.round("p", 6).alias("p"))


# --- score distributions: every word of a motif in SQL --------------------------------------------
SQL["mots2"] = "mots2 AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{w}', {t}::DOUBLE)" for n, w, t in FAVOURED) + ") v(motif, word, top))"
# Words score by their number of favoured letters only: k of L, in C(L, k) 3 ** (L - k) words of 4 ** L.
SQL["dist"] = """sc AS (SELECT motif, length(word) AS len, k, top, k * ln(top * 4) + (length(word) - k) * ln((1 - top) / 3 * 4) AS x,
  factorial(length(word)::INTEGER) / factorial(k::INTEGER) / factorial((length(word) - k)::INTEGER) * pow(3.0::DOUBLE, length(word) - k) / pow(4.0::DOUBLE, length(word)) AS q FROM (SELECT *, unnest(range(length(word) + 1)) AS k FROM mots2)),
 cum AS (SELECT *, sum(q) OVER (PARTITION BY motif ORDER BY k) AS c FROM sc)"""


@query("SELECT motif, k::INTEGER AS k, round(c, 6) AS p FROM cum", "mots2", "dist")
def t11_score_distribution(spark: SparkSession, d: str) -> DataFrame:
    """P(score <= x) a little above every score that a word can have."""
    rows = []
    for (n, w, t), m in zip(FAVOURED, MOTIFS, strict=True):
        dist = pwm.score_cdf(m.mat)
        rows += [(n, k, round(pwm.cdf(dist, k * float(np.log(t * 4)) + (len(w) - k) * float(np.log((1 - t) / 3 * 4)) + 0.1), 6)) for k in range(len(w) + 1)]
    return spark.createDataFrame(rows, "motif string, k int, p double")


_PS = [0.2, 0.05, 0.01, 0.001, 0.0003]


@query(f"SELECT motif, p, round(min(x), 2) AS cutoff FROM cum, (SELECT unnest({_PS})::DOUBLE AS p) WHERE c >= 1 - p GROUP BY motif, p", "mots2", "dist")
def t7_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """Score cutoffs of p-values from the distribution (T7, T9, T17)."""
    return spark.createDataFrame([(m.name, p, round(pwm.p_value_to_score(p, m.mat), 2)) for m in MOTIFS for p in _PS], "motif string, p double, cutoff double")


@query(f"SELECT motif, p, round(max(x), 6) AS cutoff FROM (SELECT motif, x, sum(q) OVER (PARTITION BY motif ORDER BY k DESC) AS above FROM sc), (SELECT unnest({_PS[:4]})::DOUBLE AS p) WHERE above > p GROUP BY motif, p", "mots2", "dist")
def t8_exact_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """The same by listing all words."""
    return spark.createDataFrame([(m.name, p, round(pwm.p_value_to_score_exact(p, m.mat), 6)) for m in MOTIFS for p in _PS[:4]], "motif string, p double, cutoff double")


@query("SELECT motif, k::INTEGER AS k, CASE WHEN c >= 0.9 THEN round(c, 6) ELSE 0 END AS p FROM cum", "mots2", "dist")
def t10_truncated(spark: SparkSession, d: str) -> DataFrame:
    """The same after the distribution is cut at 0.9: what lies below is gone."""
    rows = []
    for (n, w, t), m in zip(FAVOURED, MOTIFS, strict=True):
        dist = pwm.truncate_cdf(pwm.score_cdf(m.mat), 0.9)
        rows += [(n, k, round(pwm.cdf(dist, k * float(np.log(t * 4)) + (len(w) - k) * float(np.log((1 - t) / 3 * 4)) + 0.1), 6)) for k in range(len(w) + 1)]
    return spark.createDataFrame(rows, "motif string, k int, p double")


@query("SELECT motif, round(pow(0.25::DOUBLE, length(word)), 12) AS uniform, round(pow(0.4::DOUBLE, length(word) - length(replace(replace(word, 'C', ''), 'G', ''))) * pow(0.1::DOUBLE, length(replace(replace(word, 'C', ''), 'G', ''))), 12) AS gc_rich FROM mots2", "mots2")
def t6_background(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, round(pwm.background_probability(w), 12), round(pwm.background_probability(w, (0.1, 0.4, 0.4, 0.1)), 12)) for n, w, _ in FAVOURED], "motif string, uniform double, gc_rich double")


# --- scans ---------------------------------------------------------------------------------------
SQL["odds"] = """mo AS (SELECT motif, true AS strand, word, top FROM mots2 UNION ALL SELECT motif, false, reverse(translate(word, 'ACGT', 'TGCA')), top FROM mots2), w AS (SELECT motif, strand, length(word) AS k FROM mo),
 odds AS (SELECT motif, strand, j, base, ln(CASE WHEN word[j + 1] = base THEN top ELSE (1 - top) / 3 END / 0.25) AS s FROM (SELECT *, unnest(range(length(word))) AS j FROM mo), (SELECT unnest(['A', 'C', 'G', 'T']) AS base)),
 bases AS (SELECT doc_id, i, length(seq) AS n, seq[i + 1] AS base FROM (SELECT doc_id, seq, unnest(range(length(seq))) AS i FROM seqs)),
 win AS (SELECT doc_id, motif, strand, i - j AS start, sum(s) AS sc FROM bases JOIN odds USING (base) JOIN w USING (motif, strand) WHERE i >= j AND i - j + k <= n GROUP BY ALL)"""


@query("""SELECT doc_id, motif, coalesce(count(sc), 0) AS n_windows, round(coalesce(max(sc), '-inf'::DOUBLE), 6) AS max_score, count(*) FILTER (sc >= cut) AS n_hits
  FROM seqs CROSS JOIN (SELECT motif, 0.6 * length(word) * ln(top * 4) AS cut FROM mots2) x LEFT JOIN (SELECT * FROM win WHERE strand) USING (doc_id, motif) GROUP BY doc_id, motif""", "mots2", "seqs", "odds")
def t12_motif_matches(spark: SparkSession, d: str) -> DataFrame:
    x = scan.best_matches(dv.sequences(spark, d), "doc_id", "seq", MOTIFS)
    return x.select("doc_id", "motif", "n_windows", F.round("max_score", 6).alias("max_score"), "n_hits")


@query("SELECT doc_id, start, round(sc, 6) AS score FROM win WHERE strand AND motif = 'tata'", "mots2", "seqs", "odds")
def g6_window_scores(spark: SparkSession, d: str) -> DataFrame:
    return scan.score_windows(dv.sequences(spark, d), "doc_id", "seq", MOTIFS[0]).select("doc_id", "start", F.round("score", 6).alias("score"))


# A hit's score is logistic in -log10 of its p-value. The distribution is interpolated over the jump at a
# word's score, so the p-value lies between those of the words above it and of the words as good as it.
SQL["tails"] = """tails AS (SELECT *, sum(q) OVER (PARTITION BY motif ORDER BY k DESC) AS ge, sum(q) OVER (PARTITION BY motif ORDER BY k DESC) - q AS gt FROM sc),
 cuts AS (SELECT motif, min(x) - 1e-3 AS cut FROM cum WHERE c >= 0.999 GROUP BY motif),
 aff AS (SELECT motif, x, 1000 / (1 + exp(5 + log10(greatest(1e-20::DOUBLE, ge)))) - 1 AS lo, 1000 / (1 + exp(5 + log10(greatest(1e-20::DOUBLE, gt - 1e-9)))) + 1 AS hi FROM tails)"""


@query("""SELECT doc_id::VARCHAR AS chrom, start AS chrom_start, start + k AS chrom_end, motif AS name, strand, round(lo, 2) AS least, round(hi, 2) AS most, true AS score_fits FROM win JOIN w USING (motif, strand) JOIN cuts USING (motif) JOIN aff ON aff.motif = win.motif AND abs(x - sc) < 1e-6 WHERE sc >= cut""", "mots2", "dist", "seqs", "odds", "tails")
def t18_scan_motif(spark: SparkSession, d: str) -> DataFrame:
    """Hits on both strands; their score is held against bounds that the SQL computes from all words."""
    s = dv.sequences(spark, d).select(F.col("doc_id").cast("string").alias("chrom"), F.lit(0).cast("bigint").alias("chrom_start"), "seq")
    hits = scan.scan_regions(s, [scan.cutoff_motif(m, 1e-3) for m in MOTIFS])
    return _with_bounds(hits, dv.sequences(spark, d))


def _with_bounds(hits: DataFrame, seqs: DataFrame) -> DataFrame:
    """Bounds of a hit's score from its number of favoured letters, which is counted in its own letters."""
    from math import comb, exp, log10

    table = []
    for n, w, _ in FAVOURED:
        size = len(w)
        q = [comb(size, k) * 3 ** (size - k) / 4**size for k in range(size + 1)]
        for k in range(size + 1):
            aff = lambda p: 1000 / (1 + exp(5 + log10(max(1e-20, p))))
            table.append((n, w, w[::-1].translate(str.maketrans("ACGT", "TGCA")), k, aff(sum(q[k:])) - 1, aff(sum(q[k + 1 :]) - 1e-9) + 1))
    b = seqs.sparkSession.createDataFrame(table, "motif string, fw string, rv string, k int, lo double, hi double")
    words = b.select(F.col("motif").alias("wm"), "fw", "rv").distinct()
    x = hits.join(seqs.select(F.col("doc_id").cast("string").alias("c"), "seq"), F.col("chrom") == F.col("c")).join(F.broadcast(words), F.col("name") == F.col("wm"))
    word = F.when(F.col("strand"), F.col("fw")).otherwise(F.col("rv"))
    got = F.substring("seq", (F.col("chrom_start") + 1).cast("int"), (F.col("chrom_end") - F.col("chrom_start")).cast("int"))
    same = F.size(F.filter(F.arrays_zip(F.split(got, "").alias("a"), F.split(word, "").alias("b")), lambda z: (z["a"] == z["b"]) & (z["a"] != ""))).alias("matches")
    x = x.select("chrom", "chrom_start", "chrom_end", "name", "strand", "score", same)
    y = x.join(F.broadcast(b), (F.col("name") == F.col("motif")) & (F.col("matches") == F.col("k")))
    return y.select("chrom", "chrom_start", "chrom_end", "name", "strand", F.round("lo", 2).alias("least"), F.round("hi", 2).alias("most"), F.col("score").between(F.col("lo"), F.col("hi")).alias("score_fits"))


SQL["amb"] = "amb AS (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^ACGTNRYacgtnry]', '', 'g')) AS seq FROM documents)"


@query("""SELECT doc_id, count(*) FILTER (sc >= cut) AS n_all, count(*) FILTER (sc >= cut AND NOT unsure) AS n_sure FROM amb LEFT JOIN (
  SELECT doc_id, i - j AS start, sum(CASE base WHEN 'N' THEN 0 WHEN 'R' THEN ln((pa + pg) / 0.5) WHEN 'Y' THEN ln((pc + pt) / 0.5) ELSE ln(CASE base WHEN 'A' THEN pa WHEN 'C' THEN pc WHEN 'G' THEN pg ELSE pt END / 0.25) END) AS sc, bool_or(base IN ('N', 'R', 'Y')) AS unsure
  FROM (SELECT doc_id, length(seq) AS n, i, seq[i + 1] AS base FROM (SELECT *, unnest(range(length(seq))) AS i FROM amb)),
   (SELECT j, CASE WHEN c = 'A' THEN 0.85 ELSE 0.05 END AS pa, CASE WHEN c = 'C' THEN 0.85 ELSE 0.05 END AS pc, CASE WHEN c = 'G' THEN 0.85 ELSE 0.05 END AS pg, CASE WHEN c = 'T' THEN 0.85 ELSE 0.05 END AS pt FROM (SELECT unnest(range(6)) AS j, unnest(string_split('TATAAT', '')) AS c))
  WHERE i >= j AND i - j + 6 <= n GROUP BY doc_id, i - j) USING (doc_id), (SELECT 0.6 * 6 * ln(0.85 * 4) + 1e-9 AS cut) GROUP BY doc_id""", "amb")
def t13_ambiguous_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hits with and without the windows that hold ambiguous letters."""
    x = read_table(spark, d, "documents").select("doc_id", F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTNRYacgtnry]", "")).alias("seq"))
    m = MOTIFS[0].mat
    cut = 0.6 * pwm.optimal_score(m) + 1e-9

    def run(batches):
        for b in batches:
            rows = [(len(pwm.find_hits(m, s, cut, skip=False)[0]), len(pwm.find_hits(m, s, cut)[0])) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["doc_id", "n_all", "n_sure"])

    return x.mapInArrow(run, "doc_id bigint, n_all bigint, n_sure bigint")


# --- alignment -----------------------------------------------------------------------------------
SQL["mats"] = """lab AS (SELECT label, pos, avg(exp(x)) AS w FROM (SELECT label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL),
 ma AS (SELECT 'm' || label AS name, pos // 4 AS r, pos % 4 AS b, w / sum(w) OVER (PARTITION BY label, pos // 4) AS p FROM lab),
 mb AS (SELECT name, true AS same, r, b, p FROM ma UNION ALL SELECT name, false, 15 - r, 3 - b, p FROM ma),
 cd AS (SELECT x.name AS a, y.name AS b, same, x.r AS i, y.r AS j, 0.5 * sum(x.p * log2(x.p / ((x.p + y.p) / 2)) + y.p * log2(y.p / ((x.p + y.p) / 2))) AS d FROM ma x JOIN mb y ON x.b = y.b AND x.name < y.name GROUP BY ALL),
 al AS (SELECT a, b, same, i - j AS off, avg(d) + (pow(2.0::DOUBLE, 2 * abs(i - j)) - 1) * 0.05 / count(*) AS dist FROM cd GROUP BY a, b, same, i - j)"""


@query("""SELECT a, b, round(dist, 6) AS distance, same AS same_strand, off::INTEGER AS "offset" FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY dist, same DESC, off) AS k FROM al) WHERE k = 1""", "mats")
def t19_motif_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances, strands and offsets of the matrices made from the mean vectors of the embeddings' labels."""
    e = read_table(spark, d, "embeddings").where("label IS NOT NULL").select("label", F.posexplode("embedding").alias("i", "v"))
    g = e.groupBy("label", "i").agg(F.avg(F.exp(F.col("v").cast("double"))).alias("w"))
    g = g.withColumn("r", F.floor(F.col("i") / 4)).groupBy("label", "r").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("row"))
    g = g.withColumn("row", F.transform("row", lambda v: v / F.aggregate("row", F.lit(0.0), lambda a, b: a + b)))
    m = g.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "row"))), lambda x: x["row"]).alias("mat"))
    x = scan.pairwise_distances(m.select(F.concat(F.lit("m"), F.col("label")).alias("name"), "mat"))
    return x.select("a", "b", F.round("distance", 6).alias("distance"), "same_strand", "offset")


@query("""SELECT g.gene_id, g.gene_name, g.chrom, g.l AS gene_left, g.r AS gene_right, g.strand, t.transcript_id, t.l AS transcript_left, t.r AS transcript_right, t.coding, x.l AS exon_left, x.r AS exon_right
  FROM (SELECT * FROM elements WHERE feature = 'gene') g LEFT JOIN (SELECT * FROM elements WHERE feature = 'transcript') t USING (gene_id)
  LEFT JOIN (SELECT DISTINCT transcript_id, l, r FROM elements WHERE feature = 'exon') x ON x.transcript_id = t.transcript_id""", "elements")
def a14_gene_rows(spark: SparkSession, d: str) -> DataFrame:
    """Gene models with the coordinates, strands and coding of all that is nested in them."""
    return gene_rows(an.gene_models(dv.gene_elements(spark, d)))
