"""Motif operators on DataFrames. Motifs are parameters: they travel with the task, the sequences stay where they are."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixframe.motif import pwm
from helixframe.motif.align import aligner
from helixframe.motif.pwm import Motif

#: Motifs are sent to every task; their number is checked against this.
MAX_MOTIFS = 10_000


@dataclass
class CutoffMotif:
    """A motif with what scanning needs: both strands' tables, the cutoff score and the upper score distribution."""

    name: str
    forward: np.ndarray
    reverse: np.ndarray
    cutoff: float
    dist: tuple[np.ndarray, np.ndarray]


def cutoff_motif(m: Motif, p: float, bg=pwm.UNIFORM) -> CutoffMotif:
    """Prepare a motif for hits of p-value ``p``; the cutoff of the forward matrix serves both strands."""
    d = pwm.score_cdf(m.mat, bg)
    return CutoffMotif(m.name, pwm.log_odds(m.mat, bg), pwm.log_odds(pwm.reverse_complement(m.mat), bg), pwm.cdf_inverse(d, 1 - p), pwm.truncate_cdf(d, 1 - 10 * p))


def affinity(p_value: float) -> int:
    """Score from 0 to 1000, logistic in -log10 p around 5, rounded half to even."""
    x = -math.log10(max(1e-20, p_value))
    return round(1000 / (1 + math.exp(5 - x)))


def _check(n: int) -> None:
    if n > MAX_MOTIFS:
        raise ValueError(f"more than {MAX_MOTIFS} motifs")


def scan_regions(regions: DataFrame, motifs: list[CutoffMotif]) -> DataFrame:
    """Hits on both strands as BED6 from regions with their sequence ``chrom, chrom_start, seq``.

    Regions without a sequence, or with letters that are no nucleotides, give no hits; windows with
    ambiguous letters are skipped.
    """
    _check(len(motifs))
    x = regions.where(F.col("seq").isNotNull()).select("chrom", "chrom_start", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for c, s, seq in zip(*(col.to_pylist() for col in b.columns), strict=True):
                try:
                    codes = pwm.encode(seq)
                except ValueError:
                    continue
                amb = np.concatenate([[0], np.cumsum(codes > 3)])
                for m in motifs:
                    k = len(m.forward)
                    for plus, table in ((True, m.forward), (False, m.reverse)):
                        w = pwm.window_scores(table, codes)
                        if len(w):
                            for i in np.flatnonzero((w >= m.cutoff) & (amb[k:] == amb[: len(amb) - k])):
                                out.append((c, s + int(i), s + int(i) + k, m.name, affinity(1 - pwm.cdf(m.dist, w[i])), plus))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], names=["chrom", "chrom_start", "chrom_end", "name", "score", "strand"])

    return x.mapInArrow(run, "chrom string, chrom_start bigint, chrom_end bigint, name string, score int, strand boolean")


def best_matches(seqs: DataFrame, key: str, seq: str, motifs: list[Motif], bg=pwm.UNIFORM, threshold: float | None = None) -> DataFrame:
    """Per sequence and motif: ``key, motif, n_windows, max_score, n_hits``; too short or invalid ones give -inf and 0."""
    _check(len(motifs))
    x = seqs.select(F.col(key).alias("k"), F.col(seq).alias("s"))
    tables = [(m.name, pwm.log_odds(m.mat, bg), pwm.optimal_score(m.mat, bg) * 0.6 if threshold is None else threshold) for m in motifs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    codes = pwm.encode(s or "")
                except ValueError:
                    codes = np.zeros(0, np.int8)
                for name, table, th in tables:
                    w = pwm.window_scores(table, codes)
                    rows.append((k, name, len(w), float(w.max()) if len(w) else -math.inf, int((w >= th).sum())))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *[pa.array(v, t) for v, t in zip(cols[1:], [pa.string(), pa.int64(), pa.float64(), pa.int64()], strict=True)]], names=["k", "motif", "n_windows", "max_score", "n_hits"])

    y = x.mapInArrow(run, f"k {x.schema['k'].dataType.simpleString()}, motif string, n_windows bigint, max_score double, n_hits bigint")
    return y.withColumnRenamed("k", key)


def score_windows(seqs: DataFrame, key: str, seq: str, motif: Motif, bg=pwm.UNIFORM) -> DataFrame:
    """Score of every window: ``key, start, score``. Too short, NULL and invalid sequences give no row."""
    x = seqs.where(F.col(seq).isNotNull()).select(F.col(key).alias("k"), F.col(seq).alias("s"))
    table = pwm.log_odds(motif.mat, bg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in enumerate(b.column(1).to_pylist()):
                try:
                    w = pwm.window_scores(table, pwm.encode(s))
                except ValueError:
                    continue
                if len(w):
                    k = b.column(0).take(pa.array(np.full(len(w), i)))
                    yield pa.RecordBatch.from_arrays([k, pa.array(np.arange(len(w))), pa.array(w)], names=["k", "start", "score"])

    y = x.mapInArrow(run, f"k {x.schema['k'].dataType.simpleString()}, start bigint, score double")
    return y.withColumnRenamed("k", key)


def pairwise_distances(a: DataFrame, b: DataFrame | None = None, **options) -> DataFrame:
    """Distances of motif tables ``name, mat``: ``a, b, distance, same_strand, offset``; within ``a`` each pair once.

    The second table is the parameter side: it is checked to hold at most ``MAX_MOTIFS`` motifs and is
    sent to the tasks that hold the first.
    """
    other = a if b is None else b
    rows = other.select("name", "mat").orderBy("name").limit(MAX_MOTIFS + 1).collect()
    _check(len(rows))
    right = [(r[0], np.array(r[1], dtype=float)) for r in rows]
    within = b is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(**options)
        for x in batches:
            out = [(n, n2, *align(np.array(m, dtype=float), m2)) for n, m in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True) for n2, m2 in right if not within or n < n2]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, [pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.int32()], strict=True)], names=["a", "b", "distance", "same_strand", "offset"])

    return a.select("name", "mat").mapInArrow(run, "a string, b string, distance double, same_strand boolean, offset int")
