"""Mixing sources to target weights by balanced sampling (cube method).

Each source gets a rate: so many whole copies of every document and a fractional copy. Which documents
get the fractional copy is drawn by the cube method: the vector of inclusion probabilities walks along
the null space of the constraints (document count and token total of the source stay what the
probabilities promise) until it meets a face of the unit cube. Walks run in parallel over hash buckets
and leave at most two undecided documents each; those are gathered and walked again, level by level,
until at most two a source are left for the landing.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from helixframe.runtime import materialize

#: Documents of one walk.
WALK = 20_000
_EPS = 1e-9


def flight(prob: list[float], size: list[float], rng: random.Random) -> tuple[list[float], list[int]]:
    """Walk until no three probabilities are strictly between 0 and 1; returns them and who is undecided.

    Three open units and two constraints leave one free direction, the cross product of (1, 1, 1) and
    their sizes. The side is drawn so that every expectation is kept.
    """
    p, open_ = list(prob), []
    for k in range(len(p)):
        if not _EPS < p[k] < 1 - _EPS:
            p[k] = float(round(p[k]))
            continue
        open_.append(k)
        if len(open_) < 3:
            continue
        a, b, c = open_
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)  # equal sizes: any direction that keeps the count
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(open_, u, strict=True) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(open_, u, strict=True) if d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(open_, u, strict=True):
            p[i] += step * d
            if p[i] < _EPS:
                p[i] = 0.0
            elif p[i] > 1 - _EPS:
                p[i] = 1.0
        open_ = [i for i in open_ if 0 < p[i] < 1]
    return p, open_


def landing(prob: list[float], size: list[float], rng: random.Random) -> list[int]:
    """Decide the last documents (two at most): the outcomes that keep the count, else the expectation."""
    if len(prob) == 2 and abs(prob[0] + prob[1] - 1) < 1e-6:
        return [1, 0] if rng.random() < prob[0] else [0, 1]
    return [int(rng.random() < q) for q in prob]


def _walk(final: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "k"], kind="stable")
        rng = random.Random(f"{seed}/{pdf['source'].iloc[0]}/{pdf['bkt'].iloc[0]}/{len(pdf)}")
        size = pdf["n"].astype(float).tolist()
        p, left = flight(pdf["p"].tolist(), size, rng)
        if final:
            for i, v in zip(left, landing([p[i] for i in left], [size[i] for i in left], rng), strict=True):
                p[i] = float(v)
        return pdf.assign(p=p)

    return run


def rates(sizes: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Copies per document for each source, from ``{source: (docs, tokens)}`` and ``{source: (share, cap)}``.

    Sources without tokens cannot contribute; the shares of the others are scaled to add up to 1. Without
    ``total`` the mix is as large as the caps allow with every share met. With ``total``, a source whose
    cap is too low gives all it may, so its share falls short.
    """
    live = {s: (w, c) for s, (w, c) in targets.items() if w > 0 and c > 0 and sizes.get(s, (0, 0))[1] > 0}
    whole = sum(w for w, _ in live.values())
    if not live:
        return {}
    most = min(c * sizes[s][1] * whole / w for s, (w, c) in live.items())
    t = most if total is None else total
    return {s: min(float(c), t * w / whole / sizes[s][1]) for s, (w, c) in live.items()}


def mix(items: DataFrame, targets: DataFrame, *, key: str = "doc_id", source: str = "source", size: str = "n_tokens", total_tokens: float | None = None, seed: int = 1, walk: int = WALK) -> DataFrame:
    """Copies of each document in the mix: ``key, source, n_tokens, copies`` (at least 1).

    ``targets`` (``source, target_share, max_repeats``) is a parameter table of at most 10,000 rows.
    Sources are compared exactly; documents of other or NULL sources, and targets without tokens, do
    not take part. NULL sizes count as 0. Empty inputs give no row. The draw depends on the seed and
    the rows only, not on their order or partitions. ``items`` is read twice: give a written table.
    """
    rows = targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("targets is a parameter table of at most 10,000 rows")
    want = {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in rows}
    x = items.select(F.col(key).alias("k"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n")).where(F.col("source").isin(list(want) or [""]))
    have = {r[0]: (r[1], r[2]) for r in x.groupBy("source").agg(F.count(F.lit(1)), F.sum("n")).collect()}  # at most one row a target
    rate = rates(have, want, total_tokens)
    empty = x.select(F.col("k").alias(key), F.col("source").alias(source), F.col("n").alias(size), F.lit(1).alias("copies")).where(F.lit(False))
    if not rate:
        return empty
    per = F.create_map(*[v for s, r in rate.items() for v in (F.lit(s), F.lit(r))])
    n_buckets = max(1, -(-max(have[s][0] for s in rate) // walk))
    x = x.where(F.col("source").isin(list(rate))).withColumn("r", per[F.col("source")]).withColumn("base", F.floor(F.col("r") + 1e-12).cast("int"))
    x = x.withColumn("p", F.greatest(F.lit(0.0), F.col("r") - F.col("base"))).withColumn("h", F.xxhash64(F.lit(seed), "k")).drop("r")
    schema = f"k {x.schema['k'].dataType.simpleString()}, source string, n bigint, base int, p double, h bigint, bkt bigint"
    x = x.withColumn("bkt", F.pmod(F.shiftright("h", 20), F.lit(n_buckets)).cast("bigint"))
    decided, level = [], 0
    while True:
        y = x.select("k", "source", "n", "base", "p", "h", "bkt").groupBy("source", "bkt").applyInPandas(_walk(n_buckets == 1, seed + level), schema)
        if n_buckets == 1:
            decided.append(y)
            break
        t = materialize(y, "walk")
        still = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(t.where(~still))
        n_buckets, level = -(-2 * n_buckets // walk), level + 1
        x = t.where(still).withColumn("bkt", F.floor(F.col("bkt") / F.lit(walk // 2)).cast("bigint"))
    out = decided[0]
    for y in decided[1:]:
        out = out.union(y)
    out = out.withColumn("copies", (F.col("base") + F.round("p").cast("int")))
    return out.where("copies > 0").select(F.col("k").alias(key), F.col("source").alias(source), F.col("n").alias(size), "copies")


def available(items: DataFrame, targets: DataFrame, *, source: str = "source", size: str = "n_tokens") -> DataFrame:
    """Per target source: ``source, available_documents, available_tokens`` of ``items`` (sources without any have no row)."""
    t = targets.select(F.col("source").alias("__t")).distinct()
    x = items.select(F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n")).join(t, F.col("source") == F.col("__t"), "left_semi")
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("available_documents"), F.sum("n").alias("available_tokens"))


def shares(mixed: DataFrame, targets: DataFrame, items: DataFrame | None = None, *, source: str = "source", size: str = "n_tokens") -> DataFrame:
    """Per target: ``source, target_share, documents, copies, tokens, actual_share`` (0 where nothing was there).

    With the ``items`` the mix was drawn from also ``available_documents, available_tokens``,
    ``used_tokens`` (each document of the mix once) and ``used_share``, the used part of the available.
    """
    g = mixed.groupBy(F.col(source).alias("s")).agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col(size)).alias("tokens"), F.sum(size).alias("used_tokens"))
    total = mixed.agg(F.sum(F.col("copies") * F.col(size)).alias("t")).scalar()
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    x = targets.join(g, F.col("source") == F.col("s"), "left").select("source", "target_share", z("documents"), z("copies"), z("tokens"), F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)).alias("actual_share"), z("used_tokens"))
    if items is None:
        return x.drop("used_tokens")
    a = available(items, targets, source=source, size=size).withColumnRenamed("source", "s")
    y = x.join(a, F.col("source") == F.col("s"), "left")
    return y.select(*[c for c in x.columns if c != "used_tokens"], z("available_documents"), z("available_tokens"), "used_tokens", F.coalesce(F.try_divide("used_tokens", "available_tokens"), F.lit(0.0)).alias("used_share"))
