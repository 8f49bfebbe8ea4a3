"""Filling fixed-capacity boxes with items: minimum bin slack on the multiset of lengths.

Only lengths matter, so the whole corpus is packed through its histogram, which has at most
``capacity`` entries. Lengths are dealt by hash to shards of about ``SHARD_LENGTHS``, each a task of its
own that turns its part of the histogram into recipes ("one item of 1800 and two of 124, 5000 times");
every shard holds long and short lengths alike. The rows then find their recipe through their number
within their length: they are numbered within buckets, whose number follows the count of the length,
and each bucket knows the few recipes its numbers fall into.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from helixframe.runtime import materialize

#: Rows of one bucket of a length, about.
BUCKET_ROWS = 50_000
#: Lengths that are planned together, about.
SHARD_LENGTHS = 8192


def fill_window(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of ``lengths`` (descending, each at most ``counts`` times) whose sum is nearest to ``room`` from below.

    Bitset subset-sum: bit s of the integer tells whether s can be reached. Counts are split in powers
    of two; the bitset before each step is kept so that the counts can be traced back.
    """
    full, mask = 1 << room, (1 << (room + 1)) - 1
    bits, steps = 1, []
    for x in lengths:
        left, take = min(counts[x], room // x), 1
        while left > 0 and not bits & full:
            take = min(take, left)
            new = bits | (bits << (take * x)) & mask
            if new != bits:
                steps.append((x, take, bits))
                bits = new
            left -= take
            take *= 2
        if bits & full:
            break
    at, used = bits.bit_length() - 1, {}
    for x, take, before in reversed(steps):
        if not (before >> at) & 1:
            used[x] = used.get(x, 0) + take
            at -= take * x
    return used


def recipes(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``[(times, {length: count})]`` that uses every item of the histogram exactly once.

    Each window takes the longest item that is left and fills the rest of the box; the recipe is
    repeated as often as the counts allow.
    """
    left = {k: v for k, v in histogram.items() if k > 0 and v > 0}
    order = sorted(left, reverse=True)
    out = []
    while order:
        top = order[0]
        room = capacity - top
        left[top] -= 1
        use = fill_window([x for x in order if x <= room and left[x]], left, room) if room else {}
        left[top] += 1
        use[top] = use.get(top, 0) + 1
        times = min(left[x] // k for x, k in use.items())
        for x, k in use.items():
            left[x] -= times * k
        out.append((times, use))
        if any(not left[x] for x in use):
            order = [x for x in order if left[x]]
    return out


def _recipe_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    box, shard, cap = pdf["box_name"].iloc[0], int(pdf["shard"].iloc[0]), int(pdf["capacity"].iloc[0])
    seen: dict[int, int] = {}
    rows, base = [], 0
    for times, use in recipes(dict(zip(pdf["len"].astype(int), pdf["n"].astype(int), strict=True)), cap):
        for x, k in use.items():
            lo = seen.get(x, 0)
            seen[x] = lo + times * k
            rows.append((box, shard, x, lo, seen[x], k, base, times))
        base += times
    return pd.DataFrame(rows, columns=["box_name", "shard", "len", "lo", "hi", "per_box", "base", "times"])


def plan_boxes(hist: DataFrame, boxes: list[tuple[str, int]]) -> DataFrame:
    """Recipes of the histograms ``box_name, len, n, capacity``: items ``lo`` to ``hi`` of a length go, ``per_box`` a box, to the boxes from ``base`` on."""
    known = {r[0]: r[1] for r in hist.groupBy("box_name").count().collect()}  # a row a box kind
    shards = {b: max(1, -(-known.get(b, 0) // SHARD_LENGTHS)) for b, _ in boxes}
    of = F.create_map(*[v for b, n in shards.items() for v in (F.lit(b), F.lit(n))])
    h = hist.withColumn("shard", F.pmod(F.xxhash64(F.least("len", F.col("capacity") - F.col("len"))), of[F.col("box_name")]).cast("int"))
    # A partition a shard: small as the histograms are, their plans are to be made side by side.
    plan = h.repartition(sum(shards.values()), "box_name", "shard").groupBy("box_name", "shard").applyInPandas(_recipe_rows, "box_name string, shard int, len bigint, lo bigint, hi bigint, per_box bigint, base bigint, times bigint")
    plan = materialize(plan, "plan")
    used = plan.groupBy("box_name", "shard").agg(F.max(F.col("base") + F.col("times")).alias("used"))
    before = used.select(F.col("box_name").alias("b"), F.col("shard").alias("s"), (F.sum("used").over(Window.partitionBy("box_name").orderBy("shard")) - F.col("used")).alias("first"))
    x = plan.join(before, (F.col("box_name") == F.col("b")) & (F.col("shard") == F.col("s")))
    return x.select("box_name", "len", "lo", "hi", "per_box", (F.col("base") + F.col("first")).alias("base"))


def pack(items: DataFrame, boxes: list[tuple[str, int]], *, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Put every item into boxes of each capacity: ``box_name, key, piece, piece_start, piece_tokens, box_no``.

    An item is split only if it exceeds the capacity: into full pieces (each fills a box) and one rest.
    Boxes are numbered from 0 for each ``box_name``. Items of size 0 or NULL take no room and come out
    once with ``box_no`` NULL. Repeated keys are items of their own. ``items`` is read several times:
    give a written table. Empty in, empty out; a capacity below 1 is refused. What is looked up by
    length has at most as many rows as the capacities add up to, and the planner broadcasts it by its
    measured size only.
    """
    if any(c is None or c < 1 for _, c in boxes):
        raise ValueError("capacities must be at least 1")
    if not boxes:
        raise ValueError("no boxes given")
    kinds = F.array(*[F.struct(F.lit(b).alias("box_name"), F.lit(int(c)).cast("bigint").alias("capacity")) for b, c in boxes])
    x = items.select(F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("sz")).withColumn("b", F.explode(kinds)).select("k", "sz", "b.*")
    last = F.greatest(F.lit(0), F.floor((F.col("sz") - 1) / F.col("capacity")))
    x = x.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    x = x.withColumn("len", F.least("capacity", F.col("sz") - F.col("piece") * F.col("capacity")))
    hist = materialize(x.where("len > 0").groupBy("box_name", "len").agg(F.count(F.lit(1)).alias("n"), F.max("capacity").alias("capacity")), "histogram")
    plan = materialize(plan_boxes(hist, boxes), "recipes")
    part = ["box_name", "len", "bkt"]
    some = hist.select(F.col("box_name").alias("h_box"), F.col("len").alias("h_len"), F.ceil(F.col("n") / BUCKET_ROWS).alias("n_bkt"))
    y = x.where("len > 0").join(some, (F.col("box_name") == F.col("h_box")) & (F.col("len") == F.col("h_len")))
    y = y.withColumn("bkt", F.pmod(F.xxhash64("k", "piece"), F.col("n_bkt"))).drop("h_box", "h_len", "n_bkt")
    run = Window.partitionBy("box_name", "len").orderBy("bkt")  # a row a bucket
    counts = y.groupBy(*part).agg(F.count(F.lit(1)).alias("c")).withColumn("off", F.sum("c").over(run) - F.col("c"))
    seg = plan.select(F.col("box_name").alias("s_box"), F.col("len").alias("s_len"), "lo", "hi", "per_box", "base")
    near = (F.col("box_name") == F.col("s_box")) & (F.col("len") == F.col("s_len")) & (F.col("lo") < F.col("off") + F.col("c")) & (F.col("hi") > F.col("off"))
    info = counts.join(seg, near).groupBy(*[F.col(c).alias(f"o_{c}") for c in part]).agg(F.first("off").alias("off"), F.collect_list(F.struct("lo", "hi", "per_box", "base")).alias("seg"))
    w = Window.partitionBy(*part).orderBy("k", "piece")
    z = y.withColumn("rn", F.row_number().over(w) - 1)
    z = z.join(info, (F.col("box_name") == F.col("o_box_name")) & (F.col("len") == F.col("o_len")) & (F.col("bkt") == F.col("o_bkt"))).withColumn("i", F.col("rn") + F.col("off"))
    mine = F.get(F.filter("seg", lambda s: (s["lo"] <= F.col("i")) & (F.col("i") < s["hi"])), F.lit(0))
    z = z.withColumn("m", mine).withColumn("box_no", F.col("m.base") + F.floor((F.col("i") - F.col("m.lo")) / F.col("m.per_box")))
    out = lambda d: d.select("box_name", F.col("k").alias(key), "piece", (F.col("piece") * F.col("capacity")).alias("piece_start"), F.col("len").alias("piece_tokens"), "box_no")
    return out(z).unionByName(out(x.where("len <= 0").withColumn("len", F.lit(0).cast("bigint")).withColumn("box_no", F.lit(None).cast("bigint"))))


def slack(packed: DataFrame, boxes: list[tuple[str, int]]) -> DataFrame:
    """Per box kind: boxes, tokens, the fewest boxes any packing needs, and the unused share."""
    cap = F.create_map(*[v for b, c in boxes for v in (F.lit(b), F.lit(int(c)))])
    g = packed.where("box_no IS NOT NULL").groupBy("box_name").agg((F.max("box_no") + 1).alias("n_boxes"), F.sum("piece_tokens").alias("n_tokens"))
    c = cap[F.col("box_name")]
    return g.select("box_name", "n_boxes", "n_tokens", F.ceil(F.col("n_tokens") / c).alias("least_boxes"), (1 - F.col("n_tokens") / (F.col("n_boxes") * c)).alias("unused_share"))
