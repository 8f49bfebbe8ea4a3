"""Queries of the operators for training data, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.llm import mixing, packing, repetition, tokens, topn
from helixframe.runtime import materialize, read_table


#: Where the vocabulary lies, unless the session says so in ``spark.helixframe.vocabulary``.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _counted(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    path = spark.conf.get("spark.helixframe.vocabulary", VOCABULARY)
    return materialize(tokens.with_token_counts(read_table(spark, d, "documents"), list(keep), path), "tokens")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n_per_group(read_table(spark, d, "narrowpeak"), "np_chrom", "np_signal", ["np_name", "peak_id"], 3).select("np_chrom", "rnk", "peak_id")


def _boxes(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    rows = read_table(spark, d, "pack_capacity").select("box_name", "capacity_tokens").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("pack_capacity is a parameter table of at most 1,000 rows")
    return [(r[0], r[1]) for r in rows]


def _packed(spark: SparkSession, d: str) -> DataFrame:
    n = _counted(spark, d, "doc_id")
    return packing.pack(n, _boxes(spark, d))


def p8_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The box of every piece of every document, for each capacity."""
    return _packed(spark, d)


def p8_slack(spark: SparkSession, d: str) -> DataFrame:
    """Boxes used, fewest possible, and unused share for each capacity."""
    return packing.slack(_packed(spark, d), _boxes(spark, d))


def p8_balance(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: documents, those with text, those whose pieces do not add up, and boxes that are too full."""
    n = _counted(spark, d, "doc_id")
    boxes = _boxes(spark, d)
    x = materialize(packing.pack(n, boxes), "packed")
    cap = spark.createDataFrame(boxes, "b string, capacity_tokens int")
    per = x.groupBy("box_name", "doc_id").agg(F.count(F.lit(1)).alias("c"), F.max("piece").alias("m"), F.sum("piece_tokens").alias("t"), F.min((F.col("piece_tokens") > 0)).alias("full"), F.sum("piece_start").alias("st"))
    per = per.join(n, "doc_id").join(cap, F.col("box_name") == F.col("b"))
    broken = (F.col("m") + 1 != F.col("c")) | (F.col("t") != F.col("n_tokens")) | (F.col("st") != F.col("capacity_tokens") * F.col("c") * (F.col("c") - 1) / 2)
    g = per.groupBy("box_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("full").alias("n_with_text"), F.count_if(broken).alias("n_broken"))
    over = x.where("box_no IS NOT NULL").groupBy("box_name", "box_no").agg(F.sum("piece_tokens").alias("t")).join(cap, F.col("box_name") == F.col("b")).groupBy(F.col("b").alias("ob")).agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_over"))
    return g.join(over, F.col("box_name") == F.col("ob"), "left").select("box_name", "capacity_tokens", "n_documents", "n_with_text", "n_broken", F.coalesce("n_over", F.lit(0)).alias("n_over_full"))


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, "doc_id", "source")


def _corpus_total(lengths: DataFrame, targets: DataFrame) -> int:
    return mixing.available(lengths, targets).agg(F.sum("available_tokens")).collect()[0][0] or 0


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mix with their copies."""
    return mixing.mix(_lengths(spark, d), read_table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source, and how much of the source the mix uses."""
    n, targets = _lengths(spark, d), read_table(spark, d, "mix_targets")
    return mixing.shares(materialize(mixing.mix(n, targets), "mix"), targets, n)


def p9_mix_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The mix with as many tokens as the target sources have; a source whose cap is too low falls short of its share."""
    n, targets = _lengths(spark, d), read_table(spark, d, "mix_targets")
    return mixing.mix(n, targets, total_tokens=_corpus_total(n, targets))


def p9_shares_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The same report for the mix of the corpus' size."""
    n, targets = _lengths(spark, d), read_table(spark, d, "mix_targets")
    return mixing.shares(materialize(mixing.mix(n, targets, total_tokens=_corpus_total(n, targets)), "mix"), targets, n)


def p9_balance(spark: SparkSession, d: str) -> DataFrame:
    """Per target: its documents, those repeated more often than allowed or never seen in the table, and whether its share is met but for two documents (the landing)."""
    n, targets = _lengths(spark, d), read_table(spark, d, "mix_targets")
    m = materialize(mixing.mix(n, targets), "mix")
    live = n.groupBy("source").agg(F.count(F.lit(1)).alias("available"), F.sum("n_tokens").alias("tok"), F.max("n_tokens").alias("longest"))
    g = m.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t"), F.max("copies").alias("most"), F.count_distinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("rows"))
    x = targets.join(live, "source", "left").join(g, "source", "left")
    share, total, longest = x.where("tok > 0").agg(F.sum("target_share"), F.sum("t"), F.sum("longest")).first()
    fits = F.abs(F.col("t") - F.col("target_share") * F.lit((total or 0) / (share or 1))) <= 2 * (F.col("longest") + F.lit(longest or 0))
    return x.select("source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available_documents"), (F.coalesce(F.col("most") > F.col("max_repeats"), F.lit(False)) | F.coalesce(F.col("docs") != F.col("rows"), F.lit(False))).alias("repeated_too_often"),
        F.coalesce(fits, F.col("tok").isNull()).alias("share_met"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents the posterior names, then the exact definition."""
    x = repetition.likely_repetitive(read_table(spark, d, "documents"))
    return x.where((F.col("n_words") > 0) & (F.col("n_repeated") * 10 >= F.col("n_words") * 3)).select("doc_id")


def p10_repetition(spark: SparkSession, d: str) -> DataFrame:
    """Every document's measures, votes and posterior."""
    return repetition.repetition(read_table(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Every document's share of repeated words, measured exactly."""
    return repetition.repetition(read_table(spark, d, "documents")).select("doc_id", "n_words", "n_repeated", F.round("repeated_share", 9).alias("repeated_share"))


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    """Documents kept as clean by the posterior of their votes alone."""
    return repetition.quality(read_table(spark, d, "documents")).where(F.col("p_clean") > 0.5).select("doc_id")


def p10_rules(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and estimated accuracy of each rule."""
    return repetition.rule_report(read_table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p8_boxes, p8_slack, p8_balance, p9_mix, p9_shares, p9_balance, p9_mix_corpus, p9_shares_corpus, p10_found, p10_repetition, p10_shares, p10_kept, p10_rules)}

_REPEATED = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
      g AS (SELECT doc_id, unnest(range(1, len(w) - 4)) AS i, w FROM w WHERE len(w) >= 6),
      k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, array_to_string(w[i:i+5], ' ') ORDER BY i) > 1 AS again FROM g),
      m AS (SELECT DISTINCT doc_id, unnest(range(i, i + 6)) AS pos FROM k WHERE again),
      c AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id)"""

ORACLE = {
    "p2_found": """SELECT np_chrom, rnk::INTEGER AS rnk, peak_id FROM (SELECT *, row_number() OVER (PARTITION BY np_chrom ORDER BY np_signal DESC, np_name ASC NULLS LAST, peak_id) AS rnk
      FROM narrowpeak WHERE np_signal IS NOT NULL AND NOT isnan(np_signal)) WHERE rnk <= 3""",
    "p8_balance": """SELECT box_name, capacity_tokens, (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM documents WHERE text <> '') AS n_with_text,
      (SELECT count(*) - count(DISTINCT doc_id) FROM documents) AS n_broken, (SELECT count(*) FROM pack_capacity WHERE capacity_tokens < 1) AS n_over_full FROM pack_capacity""",
    "p9_balance": """SELECT source, target_share, max_repeats, coalesce(n, 0) AS available_documents, max_repeats < 1 AS repeated_too_often, target_share >= 0 AS share_met
      FROM mix_targets LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) USING (source)""",
    "p10_found": f"WITH {_REPEATED} SELECT doc_id FROM c JOIN w USING (doc_id) WHERE n * 10 >= len(w) * 3",
    "p10_shares": f"""WITH {_REPEATED} SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n, 0) AS n_repeated,
      round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE n / len(w) END, 9) AS repeated_share FROM w LEFT JOIN c USING (doc_id)""",
}
