"""Streaming forms of the stateless operators, and counts kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.operators.reject import parse_lines
from helixframe.sources.codecs import decode


def stream_bed(spark: SparkSession, path: str, fmt: str = "bed", *, files_per_trigger: int = 100) -> DataFrame:
    """Records of files that arrive in a folder (gzip by suffix)."""
    return decode(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).where("value != ''"), fmt)


def stream_rejects(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Lines of arriving files with the reason where they do not parse; nothing stops the stream."""
    x = spark.readStream.text(path).select(F.lit(fmt).alias("fmt"), F.col("value").alias("line"))
    return parse_lines(x, keep=["fmt"])


def counts_by_chrom(beds: DataFrame) -> DataFrame:
    """Records and bases per chrom; partial sums are combined before the shuffle, the state is one row a chrom."""
    return beds.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("chrom_end") - F.col("chrom_start")).alias("bases"))


def counts_by_window(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts per tumbling window of event time and keys; rows later than ``late`` are left out of closed windows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def run_once(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None):
    """Process what is there into an in-memory table ``name`` and stop (tests and backfills)."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.start()
    q.awaitTermination()
    return df.sparkSession.table(name)
