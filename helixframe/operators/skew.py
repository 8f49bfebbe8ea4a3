"""A few keys hold most records: heavy hitters by sketch, then a split plan.

Heavy keys are found with a frequent-items sketch (Misra-Gries family, mergeable, built map-side and
merged in one small reduce). A sketch that tracks m items misses no key above ``3.5 / m`` of the rows,
so with ``m`` tied to ``min_share`` the candidate list holds every heavy key and never more than
``2 / min_share + 1`` of them: that is the proven bound of everything broadcast here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from helixframe.runtime import materialize

#: A key is heavy, for the choice of the plan, from this share of all rows on.
HEAVY_SHARE = 1 / 256
#: Items the engine's sketch can track; shares that need more are counted exactly.
SKETCH_ITEMS = 1_000_000


def heavy_shares(df: DataFrame, key: Column, min_share: float = HEAVY_SHARE) -> DataFrame:
    """Candidates for the values of ``key`` that hold at least ``min_share`` of the non-null rows: ``hk, share``.

    A superset of the heavy values, at most ``2 / min_share + 1`` rows, lazily evaluated in one pass; the
    share is the sketch's estimate. NULL keys are left out. An empty input gives no row. Below a share of
    ``16 / SKETCH_ITEMS`` the sketch would be too narrow to miss no key, so keys are counted exactly there.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share must lie in (0, 1]")
    k = math.ceil(2 / min_share) + 1
    track = max(64, math.ceil(16 / min_share))
    rows = df.select(key.alias("hk")).where(F.col("hk").isNotNull())
    if track > SKETCH_ITEMS:
        total = rows.agg(F.count(F.lit(1)).alias("t")).scalar()
        share = F.col("n").cast("double") / total
        return rows.groupBy("hk").agg(F.count(F.lit(1)).alias("n")).select("hk", share.alias("share")).where(F.col("share") >= min_share)
    top = rows.agg(F.count(F.lit(1)).alias("t"), F.expr(f"approx_top_k(hk, {k}, {track})").alias("top"))
    return top.select("t", F.explode("top").alias("x")).select(F.col("x.item").alias("hk"), (F.col("x.count") / F.col("t")).alias("share"))


def heavy_keys(df: DataFrame, key: Column, min_share: float = HEAVY_SHARE) -> DataFrame:
    """The candidates of :func:`heavy_shares` alone: ``hk``."""
    return heavy_shares(df, key, min_share).select("hk")


def heavy_groups(df: DataFrame, cols: list[str], min_share: float = HEAVY_SHARE) -> tuple[int, list[int]]:
    """The number of rows, and 64-bit hashes of the heavy groups over ``cols``, in one pass, brought to the driver.

    Bounded by ``2 / min_share + 1`` numbers. Groups with clashing hashes are treated alike, which
    only widens the salted part of a plan and never changes a result.
    """
    k, track = math.ceil(2 / min_share) + 1, max(64, math.ceil(16 / min_share))
    if track > SKETCH_ITEMS:
        return df.count(), [r[0] for r in heavy_keys(df, F.xxhash64(*cols), min_share).collect()]
    r = df.select(F.xxhash64(*cols).alias("h")).agg(F.count(F.lit(1)), F.expr(f"approx_top_k(h, {k}, {track})")).first()
    return r[0], [x["item"] for x in r[1] or []]


def aggregate_by_key(df: DataFrame, key: str, aggs: dict[str, tuple[Column, Column]], *, salts: int = 64, min_share: float = HEAVY_SHARE) -> DataFrame:
    """Per-key aggregates, heavy keys and the rest each by their own plan, then a union.

    ``aggs`` maps an output name to ``(partial, final)``: ``partial`` over the input rows, ``final``
    over a column of the same name that holds partials (for a count: ``F.count(..)``, ``F.sum(name)``).
    Rows of heavy keys meet the candidate list by broadcast join, are aggregated per (key, salt) and
    merged per key, so no task sees more than 1/salts of a key. The rest goes through one ordinary
    shuffle. NULL keys form one group, treated as heavy. The column ``is_candidate`` tells the plan
    that made the row. An empty input gives no row.
    """
    heavy = F.broadcast(heavy_keys(df, F.col(key), min_share).withColumnRenamed("hk", "__hf_hk"))
    flagged = df.join(heavy, F.col(key) == F.col("__hf_hk"), "left")
    mine = flagged.where(F.col("__hf_hk").isNotNull() | F.col(key).isNull())
    rest = df.where(F.col(key).isNotNull()).join(heavy, F.col(key) == F.col("__hf_hk"), "left_anti")
    k = F.col(key).alias("__hf_key")
    salted = mine.withColumn("__hf_salt", F.spark_partition_id() % salts)  # one partial row per task and key
    part = salted.groupBy(k, "__hf_salt").agg(*[p.alias(n) for n, (p, _) in aggs.items()])
    a = part.groupBy("__hf_key").agg(*[f.alias(n) for n, (_, f) in aggs.items()])
    b = rest.groupBy(k).agg(*[p.alias(n) for n, (p, _) in aggs.items()])
    both = a.withColumn("is_candidate", F.lit(True)).unionByName(b.withColumn("is_candidate", F.lit(False)))
    return both.withColumnRenamed("__hf_key", key)


def dominant_keys(df: DataFrame, key: str, share_num: int, share_den: int) -> DataFrame:
    """Values of ``key`` (one column of that name) that hold at least ``share_num / share_den`` of all rows.

    The sketch names the candidates at half that share; they are counted exactly through the split plan of
    :func:`aggregate_by_key`, and the threshold is applied in integers against the exact total,
    which counts rows with NULL keys too. NULL itself is never returned.
    """
    min_share = share_num / share_den / 2
    n = materialize(aggregate_by_key(df.select(key), key, {"n": (F.count(F.lit(1)), F.sum("n"))}, min_share=min_share), "counts")
    total = n.agg(F.sum("n").alias("t")).scalar()
    return n.where(F.col(key).isNotNull() & (F.col("n") * share_den >= total * share_num)).select(key)


def join_by_key(left: DataFrame, right: DataFrame, key: str, *, how: str = "inner", max_broadcast_rows: int = 100_000, salts: int = 32, min_share: float = HEAVY_SHARE) -> DataFrame:
    """Equi-join on ``key`` where a few keys of ``left`` hold most of its rows.

    ``how`` is ``inner`` or ``left``. Rows of ``left`` with heavy keys join the matching rows of
    ``right`` by broadcast when a count shows there are at most ``max_broadcast_rows`` of them, else
    they are salted and those rows of ``right`` repeated per salt. All other rows take an ordinary
    shuffle join; the parts are united. NULL keys match nothing. Columns of ``right`` that clash with
    ``left`` come out with the suffix ``_right``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    r = right.select(F.col(key).alias("__hf_rk"), *[F.col(c).alias(f"{c}_right" if c in left.columns else c) for c in right.columns if c != key])
    heavy = F.broadcast(heavy_keys(left, F.col(key), min_share).withColumnRenamed("hk", "__hf_hk"))
    isin = lambda d, c, kind: d.join(heavy, d[c] == F.col("__hf_hk"), kind)
    lh, lr = isin(left, key, "left_semi"), isin(left, key, "left_anti")
    rh = isin(r, "__hf_rk", "left_semi")
    if rh.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        a = lh.join(F.broadcast(rh), F.col(key) == F.col("__hf_rk"), how)
    else:
        ls = lh.withColumn("__hf_s", (F.monotonically_increasing_id() % salts).cast("int"))
        rs = rh.withColumn("__hf_rs", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        a = ls.join(rs, (F.col(key) == F.col("__hf_rk")) & (F.col("__hf_s") == F.col("__hf_rs")), how).drop("__hf_s", "__hf_rs")
    b = lr.join(r, F.col(key) == F.col("__hf_rk"), how)
    return a.unionByName(b).drop("__hf_rk")
