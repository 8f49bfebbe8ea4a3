"""Genomes as a chunk table ``chrom, size, chunk_id, seq`` and random access by join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.functions.sequence import DNA_IUPAC, reverse_complement, validated
from helixframe.sources.files import FastaSource

#: Bases of one chunk.
CHUNK = 1 << 16


def chunk_table(fasta: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks of FASTA records (``header, body``); a chrom is named by the first word of its header."""
    s = fasta.select(F.regexp_extract("header", r"\A\s*(\S+)", 1).alias("chrom"), F.upper(F.array_join("body", "")).alias("s")).withColumn("size", F.length("s"))
    last = F.greatest(F.lit(0), F.floor((F.col("size") - 1) / F.lit(chunk)))
    x = s.withColumn("chunk_id", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return x.select("chrom", F.col("size").cast("bigint").alias("size"), "chunk_id", F.expr(f"substring(s, int(chunk_id * {chunk} + 1), {chunk})").alias("seq"))


def make_index(spark: SparkSession, fasta: str, out: str, chunk: int = CHUNK) -> None:
    """Write the chunk table of FASTA files, partitioned by chrom so that reads are pruned."""
    spark.dataSource.register(FastaSource)
    chunk_table(spark.read.format("fasta").load(fasta), chunk).write.partitionBy("chrom").parquet(out)


def open_genome(spark: SparkSession, path: str) -> DataFrame:
    """A written chunk table."""
    return spark.read.parquet(path)


def chrom_sizes(genome: DataFrame) -> DataFrame:
    """``chrom, size``."""
    return genome.where("chunk_id = 0").select("chrom", "size")


def chrom_seq(genome: DataFrame, chrom: str) -> DataFrame:
    """Chunks of one chrom in order; its whole sequence is their concatenation."""
    return genome.where(F.col("chrom") == chrom).orderBy("chunk_id").select("chunk_id", "seq")


def get_seq(regions: DataFrame, genome: DataFrame, *, chunk: int = CHUNK, stranded: bool = False) -> DataFrame:
    """The columns of ``regions`` with ``seq`` and ``seq_error`` (NULL where a sequence was found).

    ``regions`` needs a unique ``region_id``. Errors: ``unknown chromosome``, ``negative start``, ``end
    beyond chromosome``, ``empty region``, ``invalid letter``. Regions are joined to the chunks they
    touch, each cuts its piece there, and the pieces are put together per region. ``stranded`` gives
    the reverse complement on the minus strand.
    """
    r = regions.select("region_id", F.col("chrom").alias("rc"), F.col("chrom_start").alias("s"), F.col("chrom_end").alias("e"))
    sizes = chrom_sizes(genome).withColumnRenamed("size", "sz").withColumnRenamed("chrom", "sc")
    r = r.join(sizes, F.col("rc") == F.col("sc"), "left")
    err = F.when(F.col("sz").isNull(), "unknown chromosome").when(F.col("s") < 0, "negative start").when(F.col("e") > F.col("sz"), "end beyond chromosome").when(F.col("e") <= F.col("s"), "empty region")
    r = r.withColumn("err", err)
    c = F.lit(chunk)
    x = r.where("err IS NULL").withColumn("ck", F.explode(F.sequence(F.floor(F.col("s") / c), F.floor((F.col("e") - 1) / c))))
    j = x.join(genome.select(F.col("chrom").alias("gc"), "chunk_id", F.col("seq").alias("gs")), (F.col("rc") == F.col("gc")) & (F.col("ck") == F.col("chunk_id")))
    lo, hi = F.greatest(F.col("s") - F.col("ck") * c, F.lit(0)), F.least(F.col("e") - F.col("ck") * c, c)
    piece = F.substring("gs", (lo + 1).cast("int"), (hi - lo).cast("int"))
    g = j.groupBy("region_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ck", piece.alias("p")))), lambda v: v["p"]), "").alias("q"))
    y = r.select("region_id", "err").join(g, "region_id", "left")
    ok = validated(F.col("q"), DNA_IUPAC)
    y = y.select("region_id", F.when(F.col("err").isNull(), ok).alias("seq"), F.coalesce("err", F.when(ok.isNull(), "invalid letter")).alias("seq_error"))
    z = regions.join(y, "region_id", "left")
    return z.withColumn("seq", F.when(F.col("strand") == F.lit(False), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))) if stranded else z
