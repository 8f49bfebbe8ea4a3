"""Alignment records (see ``helixframe.sources.files.BAM_COLUMNS``) to intervals and reads, and read trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helixframe.functions.sequence import poly_a_trimmed

#: Bits of the flag.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, FIRST = 0x1, 0x4, 0x8, 0x10, 0x40


def _has(bit: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(bit)) != 0


def reference_span(cigar: Column) -> Column:
    """Reference bases of a CIGAR text (operations M, D, N, = and X)."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("bigint"), lambda a, v: a + v.cast("bigint"))


def bam_to_bed(bam: DataFrame) -> DataFrame:
    """BED6 of mapped records: name, mapping quality as score, strand."""
    x = bam.where(~_has(UNMAPPED) & F.col("ref").isNotNull())
    return x.select(F.col("ref").alias("chrom"), F.col("pos").alias("chrom_start"), (F.col("pos") + reference_span(F.col("cigar"))).alias("chrom_end"), F.col("qname").alias("name"), F.col("mapq").alias("score"), (~_has(REVERSE)).alias("strand"))


def bam_to_fragment(bam: DataFrame) -> DataFrame:
    """Whole fragments (BED3) of first segments whose mate is on the same reference; needs the MC tag, else raises."""
    x = bam.where(_has(FIRST) & ~_has(UNMAPPED) & ~_has(MATE_UNMAPPED) & (F.col("ref") == F.col("mate_ref")))
    mc = F.try_element_at("tags", F.lit("MC"))
    mate_end = F.col("mate_pos") + F.when(mc.isNull(), F.raise_error(F.lit("no MC tag")).cast("bigint")).otherwise(reference_span(mc))
    end = F.col("pos") + reference_span(F.col("cigar"))
    return x.select(F.col("ref").alias("chrom"), F.least("pos", "mate_pos").alias("chrom_start"), F.greatest(end, mate_end).alias("chrom_end"))


def sorted_bam_to_bedpe(bam: DataFrame, header: str) -> DataFrame:
    """Pairs of neighbouring records of a name-sorted file as two BED6 with suffixes 1 and 2.

    The header must say that the file is sorted by name, and partners must share their name, else it
    raises. A last record without partner, and pairs with an unmapped mate, are dropped. Records pair
    up by their number, so only the pair meets in a task.
    """
    if "SO:queryname" not in header:
        raise ValueError("the file is not sorted by name")
    x = bam.withColumn("pair", F.floor(F.col("rec_no") / 2)).withColumn("side", F.col("rec_no") % 2)
    rec = F.struct("qname", "flag", "ref", "pos", "mapq", "cigar")
    g = x.groupBy("pair").agg(F.max(F.when(F.col("side") == 0, rec)).alias("a"), F.max(F.when(F.col("side") == 1, rec)).alias("b")).where("b IS NOT NULL")
    g = g.withColumn("same", F.when(F.col("a.qname") != F.col("b.qname"), F.raise_error(F.lit("mates differ in name")).cast("boolean")).otherwise(True)).where("same")
    mapped = lambda s: F.col(f"{s}.flag").bitwiseAND(F.lit(UNMAPPED)) == 0
    bed = lambda s, i: [F.col(f"{s}.ref").alias(f"chrom{i}"), F.col(f"{s}.pos").alias(f"start{i}"), (F.col(f"{s}.pos") + reference_span(F.col(f"{s}.cigar"))).alias(f"end{i}"), F.col(f"{s}.mapq").alias(f"score{i}"), (F.col(f"{s}.flag").bitwiseAND(F.lit(REVERSE)) == 0).alias(f"strand{i}")]
    return g.where(mapped("a") & mapped("b")).select(F.col("a.qname").alias("name"), *bed("a", 1), *bed("b", 2))


def bam_to_fastq(bam: DataFrame) -> DataFrame:
    """``seq_id, seq, qual`` of records that have all three."""
    return bam.where("qname IS NOT NULL AND seq IS NOT NULL AND qual IS NOT NULL").select(F.col("qname").alias("seq_id"), "seq", "qual")


def trim_poly_a(reads: DataFrame, n: int) -> DataFrame:
    """Reads without their trailing run of A where it has ``n`` letters or more."""
    s, q = poly_a_trimmed(F.col("seq"), F.col("qual"), n)
    return reads.withColumns({"seq": s, "qual": q})


def fastq_lines(reads: DataFrame) -> DataFrame:
    """FASTQ texts (column ``value``, four lines each, not wrapped)."""
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "seq_id"), "seq", F.lit("+"), "qual").alias("value"))


def write_fastq(reads: DataFrame, path: str, *, gzip: bool = False, mode: str = "error") -> None:
    """A folder of FASTQ part files."""
    fastq_lines(reads).write.mode(mode).text(path, compression="gzip" if gzip else "none")
