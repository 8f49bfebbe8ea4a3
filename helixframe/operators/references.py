"""References to records that do not exist, are deleted, or come later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helixframe.operators.skew import heavy_shares


def reference_number(col: Column, separator: str) -> Column:
    """The integer after the last ``separator`` of a text, outer spaces ignored, else NULL."""
    tail = F.trim(F.substring_index(F.trim(col), separator, -1))
    return F.when(tail.rlike("\\A[0-9]+\\z"), tail.try_cast("bigint"))


def parent_validity(parents: DataFrame, key: str, created: str, deleted: str) -> DataFrame:
    """One validity interval per parent key: ``(pk, born, died)``.

    Rows delivered again are merged: the earliest creation counts, and a parent is deleted only if
    all its rows are (latest deletion). A NULL creation means that it always existed.
    """
    c, d = F.col(created).cast("timestamp"), F.col(deleted).cast("timestamp")
    g = parents.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("pk")).agg(
        F.min(c).alias("b"), F.max(c.isNull()).alias("b_null"), F.max(d).alias("e"), F.max(d.isNull()).alias("e_null"))
    return g.select("pk", F.when(~F.col("b_null"), F.col("b")).alias("born"), F.when(~F.col("e_null"), F.col("e")).alias("died"))


def orphan_references(refs: DataFrame, parents: DataFrame, *, salts: int = 1024, min_share: float = 1 / 256) -> DataFrame:
    """References without a valid parent: ``table_name, row_id, ref_id, ref_kind, ref_month``.

    ``refs`` has ``table_name, row_id, ref_id, ref_at`` (timestamp), ``parents`` the result of
    :func:`parent_validity`. Both sides are partitioned and sorted on the key and read in one linear
    merge (sort-merge join). References to a favoured key are spread over salts in proportion to its
    share, so that a salt holds about 1 / ``salts`` of all references, and the parent row is repeated for
    each; the favoured keys come from a sketch, so at most ``2 / min_share + 1`` parent rows are repeated,
    and about ``salts`` rows are made of them in all. The first that applies: ``missing`` (no parent), ``late`` (created after
    the reference), ``deleted`` (deleted not after it). Rows with a NULL ``ref_id`` are no reference.
    With a NULL ``ref_at`` only ``missing`` can be told, and the month is NULL.
    """
    r = refs.select("table_name", "row_id", "ref_id", "ref_at").where(F.col("ref_id").isNotNull())
    hot = F.broadcast(heavy_shares(r, F.col("ref_id"), min_share).select("hk", F.greatest(F.lit(1), F.ceil(F.col("share") * salts)).alias("ns")))
    left = r.join(hot, F.col("ref_id") == F.col("hk"), "left").withColumn("salt", F.pmod(F.xxhash64("table_name", "row_id"), F.coalesce("ns", F.lit(1)))).drop("hk", "ns")
    right = parents.select("pk", "born", "died").join(hot, F.col("pk") == F.col("hk"), "left").withColumn("ps", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("ns", F.lit(1)) - 1))).drop("hk", "ns")
    j = left.hint("merge").join(right, (F.col("ref_id") == F.col("pk")) & (F.col("salt") == F.col("ps")), "left")
    kind = F.when(F.col("pk").isNull(), "missing").when(F.col("born") > F.col("ref_at"), "late").when(F.col("died") <= F.col("ref_at"), "deleted")
    return j.select("table_name", "row_id", "ref_id", kind.alias("ref_kind"), F.date_format("ref_at", "yyyy-MM").alias("ref_month")).where("ref_kind IS NOT NULL")
