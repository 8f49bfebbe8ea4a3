"""Overlapping, nested and gapped intervals: continuous periods and the gaps between them.

The aggregate is a sorted list of disjoint intervals per group. It is mergeable, and the reduction
tree has three levels: lists are built over chunks of rows before the shuffle; the lists of a group
(of a slab of coordinates, for groups that hold much of the table) meet in one task, sorted by start,
and are merged in one linear streaming pass; slabs of a group are then joined at their borders, of
which there are two a slab. No group is ever held in memory, and a group with a third of all rows is
cut into slabs at its own (sampled) quantiles, as many as its rows ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from helixframe.operators.skew import heavy_groups
from helixframe.runtime import materialize

#: Rows of one leaf list.
LEAF_ROWS = 200_000
#: Groups above this share of the rows are cut into slabs.
SLAB_SHARE = 1 / 256
#: Rows of a slab at most, about; so the slabs grow with the rows.
SLAB_ROWS = 20_000_000
#: Starts that are sampled for each slab to find the cuts.
SAMPLED = 64


def _starts_of_groups(t: pa.Table, keys: list[str]) -> np.ndarray:
    """True where a row's keys differ from those of the row before (NULL equals NULL)."""
    n = t.num_rows
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
    for k in keys:
        c = t.column(k).combine_chunks()
        a, b = c[1:], c[:-1]
        ne = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = c.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= ne | (nulls[1:] != nulls[:-1])
    return new


def _merge_sorted(new: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each period, and its end, for rows sorted by (group, start)."""
    n = len(s)
    vals, rank = np.unique(e, return_inverse=True)
    top = np.maximum.accumulate((np.cumsum(new) * (len(vals) + 1)) + rank) % (len(vals) + 1)
    run = vals[top]
    first = new.copy()
    first[1:] |= s[1:] > run[:-1]
    at = np.flatnonzero(first)
    return at, run[np.append(at[1:], n) - 1]


def _cut(s: np.ndarray, e: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals cut at the borders of slabs: index of the interval, slab, start, end of each piece."""
    lo, hi = np.searchsorted(cuts, s, "right"), np.searchsorted(cuts, e - 1, "right")
    n = hi - lo + 1
    i = np.repeat(np.arange(len(s)), n)
    slab = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]
    edge = np.append(cuts, 0)
    return i, slab, np.where(slab > lo[i], edge[slab - 1], s[i]), np.where(slab < hi[i], edge[slab], e[i])


def _leaf(keys: list[str], schema: pa.Schema, cuts: dict[int, np.ndarray]):
    """Lists of disjoint intervals over chunks of rows; those of heavy groups (by hash ``h``) are cut into slabs."""

    def merge(t: pa.Table) -> pa.RecordBatch:
        codes = [c.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in (t.column(k) for k in keys)]
        s = t.column("s").to_numpy()
        order = np.lexsort([s, *codes[::-1]])
        new = np.zeros(len(s), dtype=bool)
        new[:1] = True
        for c in codes:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
        s, e = s[order], t.column("e").to_numpy()[order]
        at, end = _merge_sorted(new, s, e)
        row, start, slab = order[at], s[at], np.full(len(at), -1)
        if cuts:
            h = t.column("h").to_numpy()[row]
            groups = np.flatnonzero(new[at])
            hot = [(a, z) for a, z in zip(groups, np.append(groups[1:], len(at)), strict=True) if int(h[a]) in cuts]
            if hot:
                plain = np.ones(len(at), dtype=bool)
                parts = []
                for a, z in hot:
                    plain[a:z] = False
                    i, sl, x, y = _cut(start[a:z], end[a:z], cuts[int(h[a])])
                    parts.append((row[a:z][i], sl, x, y))
                row, slab, start, end = (np.concatenate(c) for c in zip((row[plain], slab[plain], start[plain], end[plain]), *parts, strict=True))
        out = t.select(keys).take(pa.array(row))
        return pa.Table.from_arrays([*out.columns, pa.array(slab, pa.int32()), pa.array(start), pa.array(end)], schema=schema).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= LEAF_ROWS:
                yield from merge(pa.Table.from_batches(held)).to_batches()
                held, rows = [], 0
        if held:
            yield from merge(pa.Table.from_batches(held)).to_batches()

    return run


def _linear_merge(keys: list[str], schema: pa.Schema, with_gaps: bool):
    """Merge rows sorted by (keys, slab, start); the last open period waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None  # one row: the open period, with is_first
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_arrays([*b.columns, pa.array(np.ones(b.num_rows, dtype=bool))], names=[*b.schema.names, "is_first"])
            if carry is not None:
                t = pa.concat_tables([carry, t])
            new = _starts_of_groups(t, [*keys, "slab"])
            s, e = t.column("s").to_numpy(), t.column("e").to_numpy()
            at, end = _merge_sorted(new, s, e)
            starts_group = new[at]
            first = starts_group.copy()
            if carry is not None:
                first[0] = carry.column("is_first")[0].as_py()
            p = t.select([*keys, "slab"]).take(pa.array(at))
            yield from emit(p, s[at], end, first, starts_group, len(at) - 1)
            i = len(at) - 1
            carry = pa.Table.from_arrays([*p.slice(i, 1).columns, pa.array(s[at][i:]), pa.array(end[i:]), pa.array(first[i:])], names=[*keys, "slab", "s", "e", "is_first"])
        if carry is not None:
            yield from emit(carry.select([*keys, "slab"]), carry.column("s").to_numpy(), carry.column("e").to_numpy(), carry.column("is_first").to_numpy(zero_copy_only=False), np.ones(1, dtype=bool), 1)

    def emit(p: pa.Table, s, e, first, starts_group, done: int) -> Iterator[pa.RecordBatch]:
        """Periods before ``done`` are closed; gaps lie between neighbours of one group."""
        last = np.ones(len(s), dtype=bool)
        last[:-1] = starts_group[1:]
        edge = first[:done].astype(np.int8) + 2 * last[:done].astype(np.int8)
        out = [pa.Table.from_arrays([*p.slice(0, done).columns, pa.array(["period"] * done, pa.string()), pa.array(s[:done]), pa.array(e[:done]), pa.array(edge, pa.int32())], schema=schema)]
        if with_gaps and len(s) > 1:
            g = np.flatnonzero(~starts_group[1:])
            out.append(pa.Table.from_arrays([*p.take(pa.array(g)).columns, pa.array(["gap"] * len(g), pa.string()), pa.array(e[g]), pa.array(s[g + 1]), pa.array(np.zeros(len(g), np.int32))], schema=schema))
        for t in out:
            yield from t.combine_chunks().to_batches()

    return run


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, *, with_gaps: bool = True, slab_share: float = SLAB_SHARE) -> DataFrame:
    """Continuous periods of half-open intervals per group, and the gaps between successive periods.

    Returns ``keys..., span_kind ('period'|'gap'), span_start, span_end``. Intervals that overlap or
    touch make one period. Rows with NULL borders or ``end <= start`` do not take part; NULL keys are
    groups like others; repeated rows change nothing; an empty table gives no row. Groups above
    ``slab_share`` of the rows are found first with a sketch, and their cuts from a sample of ``SAMPLED``
    starts a slab; a slab has ``slab_share`` of the rows or ``SLAB_ROWS``, whichever is less, so one
    number for each so many rows reaches the driver. The cuts change no row of the result.
    """
    names = [f"k{i}" for i in range(len(keys))]
    base = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).where("e > s")
    kfields = [base.schema[n] for n in names]
    base = base.withColumn("h", F.xxhash64(*names))
    total, hot = heavy_groups(base, names, slab_share)
    cuts = _cuts(base, hot, max(1, min(int(total * slab_share), SLAB_ROWS))) if hot else {}
    sch = lambda *fs: T.StructType([*kfields, *[T.StructField(n, t) for n, t in fs]])
    to_arrow = lambda s: pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in s])
    leaf = sch(("slab", T.IntegerType()), ("s", T.LongType()), ("e", T.LongType()))
    lists = base.mapInArrow(_leaf(names, to_arrow(leaf), cuts), leaf)
    out = sch(("slab", T.IntegerType()), ("span_kind", T.StringType()), ("span_start", T.LongType()), ("span_end", T.LongType()), ("edge", T.IntegerType()))
    order = [*names, "slab", "s"]
    merged = lists.select(*names, "slab", "s", "e").repartition(*names, "slab").sortWithinPartitions(*order).mapInArrow(_linear_merge(names, to_arrow(out), with_gaps), out)
    if cuts:
        merged = _join_slabs(materialize(merged, "periods"), names, with_gaps)
    return merged.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "span_kind", "span_start", "span_end")


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def _cuts(base: DataFrame, hot: list[int], rows: int) -> dict[int, np.ndarray]:
    """Where to cut the heavy groups (by hash), so that a slab starts about every ``rows`` intervals."""
    share = min(1.0, SAMPLED / rows)
    every = max(1, round(rows * share))
    q = base.where(F.col("h").isin(hot)).sample(share, seed=1).groupBy("h").agg(F.sort_array(F.collect_list("s")).alias("v"))
    q = q.select("h", F.array_distinct(F.filter("v", lambda x, i: (i + 1) % every == 0)).alias("cuts"))
    return {r[0]: np.array(r[1], dtype=np.int64) for r in q.collect() if r[1]}


def _join_slabs(m: DataFrame, names: list[str], with_gaps: bool) -> DataFrame:
    """Join the first and last periods of neighbouring slabs (two rows a slab at most)."""
    cols = [*names, "span_kind", "span_start", "span_end"]
    at_edge = (F.col("slab") >= 0) & (F.col("edge") > 0)
    w = Window.partitionBy(*names).orderBy("span_start")
    e = m.where(at_edge).withColumn("pe", F.lag("span_end").over(w)).withColumn("ps", F.lag("slab").over(w))
    across = F.col("ps").isNotNull() & (F.col("ps") != F.col("slab"))
    e = e.withColumn("joins", across & (F.col("pe") == F.col("span_start")))
    isl = e.withColumn("island", F.sum((~F.col("joins")).cast("int")).over(w)).groupBy(*names, "island").agg(F.lit("period").alias("span_kind"), F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"))
    parts = m.where(~at_edge).select(*cols).unionByName(isl.select(*cols))
    if with_gaps:
        gaps = e.where(across & ~F.col("joins")).select(*names, F.lit("gap").alias("span_kind"), F.col("pe").alias("s0"), F.col("span_start").alias("e0"))
        parts = parts.unionByName(gaps.select(*names, "span_kind", F.col("s0").alias("span_start"), F.col("e0").alias("span_end")))
    return parts
