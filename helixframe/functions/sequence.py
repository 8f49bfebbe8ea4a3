"""Sequence functions as column expressions (all in the JVM), and per-cycle quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Alphabets.
DNA_BASIC, DNA_IUPAC, RNA_BASIC = "ACGT", "ACGTNVHDBMKWSYR", "ACGU"
#: GC weight of each IUPAC letter; letters not listed weigh one half.
GC_WEIGHT = {"A": 0.0, "T": 0.0, "W": 0.0, "C": 1.0, "G": 1.0, "S": 1.0, "H": 0.25, "D": 0.25, "V": 0.75, "B": 0.75}


def reverse_complement(s: Column, *, iupac: bool = False) -> Column:
    """Reverse complement. Other letters are kept and only reversed, unless ``iupac`` complements them too."""
    pairs = ("ACGTVHDBMKWSYR", "TGCABDHVKMWSRY") if iupac else ("ACGT", "TGCA")
    return F.reverse(F.translate(s, *pairs))


def letter_count(s: Column, letters: str) -> Column:
    """Occurrences of any of ``letters``."""
    return F.length(s) - F.length(F.translate(s, letters, ""))


def gc_content(s: Column) -> Column:
    """Mean GC weight of the letters; NaN for an empty sequence, NULL for NULL."""
    by: dict[float, str] = {}
    for c, w in GC_WEIGHT.items():
        by[w] = by.get(w, "") + c
    known = "".join(GC_WEIGHT)
    total = sum((letter_count(s, c) * F.lit(w) for w, c in by.items()), F.lit(0.0)) + (F.length(s) - letter_count(s, known)) * F.lit(0.5)
    return F.when(F.length(s) == 0, F.lit(float("nan"))).otherwise(F.try_divide(total, F.length(s)))


def nucleotide_freq(s: Column, alphabet: str = DNA_BASIC) -> Column:
    """Map from every letter of the alphabet to its count, zeros included."""
    return F.create_map(*[v for c in alphabet for v in (F.lit(c), letter_count(s, c))])


def validated(s: Column, alphabet: str = DNA_BASIC) -> Column:
    """The sequence in upper case if all its letters belong to the alphabet, else NULL."""
    u = F.upper(s)
    return F.when(F.translate(u, alphabet, "") == "", u)


def invalid_letter(s: Column, alphabet: str = DNA_BASIC) -> Column:
    """The first letter outside the alphabet, else NULL."""
    rest = F.translate(F.upper(s), alphabet, "")
    return F.when(rest != "", F.substring(rest, 1, 1))


def slice_seq(s: Column, i: int | Column, n: int | Column) -> Column:
    """``n`` letters after the first ``i``; fewer at the end."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.substring(s, lit(i) + 1, lit(n))


def poly_a_trimmed(s: Column, q: Column, n: int) -> tuple[Column, Column]:
    """Sequence and quality without the trailing run of A, if that has at least ``n`` letters."""
    kept = F.length(F.rtrim(s, F.lit("A")))
    cut = F.length(s) - kept >= n
    return F.when(cut, F.substring(s, F.lit(1), kept)).otherwise(s), F.when(cut, F.substring(q, F.lit(1), kept)).otherwise(q)


def quality_scores(q: Column) -> Column:
    """Phred scores of a quality string (code - 33); codes below 33 raise."""
    chars = F.filter(F.split(q, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.when(F.ascii(c) >= 33, F.ascii(c) - 33).otherwise(F.raise_error(F.lit("quality code below 33")).cast("int")))


def error_probability(score: Column) -> Column:
    """10 ** (-q / 10)."""
    return F.pow(F.lit(10.0), -score / F.lit(10.0))


def quality_summary(reads: DataFrame, qual: str = "qual") -> DataFrame:
    """Per cycle (from 0): ``cycle, n, mean, m2, var`` up to the shortest read.

    ``m2`` is the sum of squared deviations, ``var`` = m2 / n. Scores are counted per (cycle, score)
    first, so what is shuffled does not grow with the reads; the sums are of integers and exact.
    """
    shortest = reads.agg(F.min(F.length(qual)).alias("m")).scalar()
    x = reads.where(F.col(qual).isNotNull()).select(F.posexplode(quality_scores(F.col(qual))).alias("cycle", "q"))
    c = x.groupBy("cycle", "q").agg(F.count(F.lit(1)).alias("k")).where(F.col("cycle") < shortest)
    g = c.groupBy("cycle").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("q")).alias("s"), F.sum(F.col("k") * F.col("q") * F.col("q")).alias("ss"))
    m2 = F.col("ss") - F.col("s").cast("double") * F.col("s") / F.col("n")
    return g.select("cycle", "n", (F.col("s") / F.col("n")).alias("mean"), m2.alias("m2"), (m2 / F.col("n")).alias("var"))
