"""Line codecs of the BED family as column expressions over ``split(line, '\\t')``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_int(c: Column) -> Column:
    """Signed integer at the start of a text, what follows is ignored; raises without one, NULL for NULL."""
    d = F.regexp_extract(c, r"\A([+-]?[0-9]+)", 1)
    return F.when(c.isNull(), None).when(d == "", F.raise_error(F.concat(F.lit("no integer: "), c)).cast("bigint")).otherwise(d.cast("bigint"))


def read_double(c: Column) -> Column:
    """Decimal number at the start of a text, what follows is ignored; raises without one, NULL for NULL."""
    d = F.regexp_extract(c, r"\A([+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)", 1)
    return F.when(c.isNull(), None).when(d == "", F.raise_error(F.concat(F.lit("no number: "), c)).cast("double")).otherwise(d.cast("double"))


def _f(i: int) -> Column:
    return F.get(F.split("value", "\t"), F.lit(i - 1))


def _need(ok: Column, what: str, then: Column) -> Column:
    return F.when(ok, then).otherwise(F.raise_error(F.concat(F.lit(f"not a {what} line: "), F.col("value"))).cast("string"))


def _dot(i: int) -> Column:
    return F.when(_f(i) != ".", _f(i))


def _score(i: int) -> Column:
    n = read_int(_dot(i))
    return F.when(n < 0, F.raise_error(F.lit("negative score")).cast("int")).otherwise(n.cast("int"))


def _plus_minus(i: int) -> Column:
    return F.when(_f(i) == "+", True).when(_f(i) == "-", False)


def _dot_plus_rest(i: int) -> Column:
    """NULL for a dot, true for plus, false for anything else (narrowPeak and broadPeak)."""
    return F.when(_f(i) == ".", None).otherwise(_f(i) == "+")


def _nonneg(c: Column) -> Column:
    return F.when(c >= 0, c)


def _columns(fmt: str) -> tuple[Column, list[Column]]:
    n = F.size(F.split("value", "\t"))
    pos = [read_int(_f(2)).alias("chrom_start"), read_int(_f(3)).alias("chrom_end")]
    peak_head = [_dot(4).alias("name"), F.coalesce(read_int(_f(5)), F.lit(0)).cast("int").alias("score"), _dot_plus_rest(6).alias("strand"), F.coalesce(read_double(_f(7)), F.lit(0.0)).alias("signal"), _nonneg(read_double(_f(8))).alias("pvalue"), _nonneg(read_double(_f(9))).alias("qvalue")]
    if fmt == "bed3":
        return n >= 3, pos
    if fmt == "bed":
        return n >= 3, [*pos, _dot(4).alias("name"), _score(5).alias("score"), _plus_minus(6).alias("strand")]
    if fmt == "bedgraph":
        return n >= 4, [*pos, read_double(_f(4)).alias("value")]
    if fmt == "narrowpeak":
        return (n == 3) | (n >= 10), [*pos, *peak_head, _nonneg(read_int(_f(10))).cast("int").alias("peak")]
    if fmt == "broadpeak":
        return n >= 9, [*pos, *peak_head]
    if fmt == "bedext":
        return n >= 4, [*pos, F.substring_index("value", "\t", -1).alias("payload")]
    raise ValueError(f"unknown format {fmt}")


def decode(lines: DataFrame, fmt: str) -> DataFrame:
    """Typed records from a column ``value`` of lines; a line that does not parse raises.

    Formats: ``bed3 bed bedgraph narrowpeak broadpeak bedext`` (the payload of bedext is the last field, a
    JSON text). To set bad lines aside instead, use :mod:`helixframe.operators.reject`.
    """
    ok, cols = _columns(fmt)
    return lines.select(_need(ok, fmt, _f(1)).alias("chrom"), *cols)


def encode(df: DataFrame, fmt: str) -> DataFrame:
    """Lines (column ``value``) of records; NULL is written as ``.``, or as -1 in the p, q and peak columns."""
    t = lambda c, none=".": F.coalesce(F.col(c).cast("string"), F.lit(none))
    strand = F.when(F.col("strand"), "+").when(~F.col("strand"), "-").otherwise(".") if "strand" in df.columns else None
    cols = [t("chrom"), t("chrom_start"), t("chrom_end")]
    if fmt == "bed":
        cols += [t("name"), t("score"), strand]
    elif fmt == "bedgraph":
        cols += [t("value")]
    elif fmt in ("narrowpeak", "broadpeak"):
        cols += [t("name"), t("score"), strand, t("signal"), t("pvalue", "-1"), t("qvalue", "-1"), *([t("peak", "-1")] if fmt == "narrowpeak" else [])]
    elif fmt == "bedext":
        cols += [t("payload")]
    elif fmt != "bed3":
        raise ValueError(f"unknown format {fmt}")
    return df.select(F.concat_ws("\t", *cols).alias("value"))


def read_bed(spark: SparkSession, path: str, fmt: str = "bed") -> DataFrame:
    """Records of files; gzip (also of several members) is read by suffix ``.gz``, one task per gzip file."""
    return decode(spark.read.text(path).where("value != ''"), fmt)


def write_bed(df: DataFrame, path: str, fmt: str = "bed", *, gzip: bool = False, mode: str = "error") -> None:
    """A folder of part files, one per partition; sort before for ordered files."""
    encode(df, fmt).write.mode(mode).text(path, compression="gzip" if gzip else "none")


def print_bed(df: DataFrame, fmt: str = "bed", out=None) -> None:
    """Lines to a handle (standard output), one partition at a time on the driver."""
    import sys

    h = out or sys.stdout
    for r in encode(df, fmt).toLocalIterator(prefetchPartitions=True):
        h.write(r[0] + "\n")
