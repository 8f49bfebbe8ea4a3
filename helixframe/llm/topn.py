"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.internal import InternalFunction


def top_n_per_group(df: DataFrame, group: str, score: str, ties: list[str], n: int) -> DataFrame:
    """The ``n`` rows of each group with the highest ``score``: ``group, rnk, ties...``.

    Equal scores are settled by ``ties`` ascending, NULL last (strings in byte order); end them with a
    unique column. The aggregate is a heap of at most ``n`` keys per group: it is built on the map
    side, only heaps are shuffled, and they are merged per group, so a group with a third of all rows
    costs ``n`` rows per task. Rows whose score is NULL or NaN do not take part; a group without other
    rows gives none. A NULL group is a group. Repeated rows all take part. Empty in, empty out.
    ``rnk`` counts from 1.
    """
    kind = df.schema[score].dataType
    s = F.col(score)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        rows, down = df.where(s.isNotNull() & ~F.isnan(s)), -s
    elif isinstance(kind, T.IntegralType):
        rows, down = df.where(s.isNotNull()), F.bitwise_not(s)
    else:
        raise TypeError("the score must be numeric")
    parts = [down.alias("s")]
    for i, c in enumerate(ties):
        parts += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"t{i}")]
    heaps = rows.groupBy(F.col(group).alias("g")).agg(InternalFunction.collect_top_k(F.struct(*parts), n, True).alias("heap"))
    x = heaps.select("g", F.posexplode(F.array_sort("heap")).alias("p", "k"))
    return x.select(F.col("g").alias(group), (F.col("p") + 1).alias("rnk"), *[F.col(f"k.t{i}").alias(c) for i, c in enumerate(ties)])
