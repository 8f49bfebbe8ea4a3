"""Logical tables of the domain, made from the driver's tables; each with the SQL that makes the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.motif.pwm import Motif
from helixframe.runtime import read_table


def tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags (BED6 and ``rec_id``)."""
    return read_table(spark, d, "bed").select("rec_id", "chrom", "chrom_start", "chrom_end", F.col("bed_name").alias("name"), F.col("bed_score").alias("score"), F.col("bed_strand").alias("strand"))


def stranded_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags with a strand, for operators that refuse others."""
    return tags(spark, d).where("strand IS NOT NULL")


def peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peaks with ``region_id``."""
    return read_table(spark, d, "narrowpeak").select(F.col("peak_id").alias("region_id"), F.col("np_chrom").alias("chrom"), F.col("np_start").alias("chrom_start"), F.col("np_end").alias("chrom_end"), F.col("np_strand").alias("strand"))


def sizes(spark: SparkSession, d: str) -> DataFrame:
    """Chrom sizes, three quarters of what the tags reach, so that clipping has work to do."""
    return tags(spark, d).groupBy("chrom").agg(F.floor(F.max("chrom_end") * 3 / 4).alias("size"))


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """The letters A, C, G, T of each text, in upper case."""
    return read_table(spark, d, "documents").select("doc_id", F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTacgt]", "")).alias("seq"))


def reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads whose quality are the printable ASCII characters of a text, where there are any."""
    q = F.regexp_replace(F.coalesce("text", F.lit("")), "[^!-~]", "")
    return read_table(spark, d, "documents").select("doc_id", q.alias("qual")).where("qual != ''")


def gene_elements(spark: SparkSession, d: str) -> DataFrame:
    """Gene model elements: customers as genes, their orders as transcripts, line items as exons."""
    null = lambda t: F.lit(None).cast(t)
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("line_no"), F.lit("gene").alias("feature"), F.concat(F.lit("chr"), F.col("c_nationkey")).alias("chrom"), (F.col("c_custkey") * 2000).alias("left"), (F.col("c_custkey") * 2000 + 1500).alias("right_incl"), (F.col("c_acctbal") >= 0).alias("strand"),
        F.col("c_custkey").cast("string").alias("gene_id"), F.col("c_name").alias("gene_name"), null("string").alias("transcript_id"), F.lit(True).alias("coding"))
    o = read_table(spark, d, "orders").select("o_orderkey", F.lit("transcript"), null("string"), F.col("o_custkey") * 2000 + F.col("o_orderkey") % 700, F.col("o_custkey") * 2000 + 800 + F.col("o_orderkey") % 600, null("boolean"), F.col("o_custkey").cast("string"), null("string"), F.col("o_orderkey").cast("string"), F.col("o_orderstatus") != "P")
    li = read_table(spark, d, "lineitem").select("l_orderkey", F.lit("exon"), null("string"), "l_partkey", F.col("l_partkey") + (F.col("l_quantity") * 10).cast("bigint"), null("boolean"), null("string"), null("string"), F.col("l_orderkey").cast("string"), F.lit(True))
    return c.union(o).union(li)


def part_links(spark: SparkSession, d: str) -> DataFrame:
    """A DAG over parts: the parents of p are floor(p / 2) and floor(p / 3); 0 is the root."""
    p = read_table(spark, d, "part").where("p_partkey > 0")
    return p.select(F.col("p_partkey").alias("child"), F.explode(F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 3))).alias("parent"))


def contact_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Read pairs in bins."""
    return read_table(spark, d, "lineitem").select((F.col("l_partkey") % 300).alias("bin1"), (F.col("l_suppkey") * 20 % 300).alias("bin2"))


#: A matrix of ten columns and one of six, made by rule: each row favours one letter.
def _favouring(letters: str, top: float) -> np.ndarray:
    m = np.full((len(letters), 4), (1 - top) / 3)
    m[np.arange(len(letters)), ["ACGT".index(c) for c in letters]] = top
    return m


MOTIFS = [Motif("tata", _favouring("TATAAT", 0.85), 20), Motif("ebox", _favouring("CACGTGAC", 0.7), 11)]

SQL = {
    "tags": "tags AS (SELECT rec_id, chrom, chrom_start, chrom_end, bed_name AS name, bed_score AS score, bed_strand AS strand FROM bed)",
    "st": "st AS (SELECT chrom, chrom_start, chrom_end, bed_strand AS strand, CASE WHEN bed_strand THEN chrom_start ELSE chrom_end - 1 END AS p5 FROM bed WHERE bed_strand IS NOT NULL)",
    "peaks": "peaks AS (SELECT peak_id AS region_id, np_chrom AS chrom, np_start AS chrom_start, np_end AS chrom_end, np_strand AS strand FROM narrowpeak)",
    "seqs": "seqs AS (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM documents)",
    "cells": "cells AS (SELECT least(l_partkey % 300, l_suppkey * 20 % 300) AS i, greatest(l_partkey % 300, l_suppkey * 20 % 300) AS j, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT i, j, n // 2 AS value FROM cells)",
}
