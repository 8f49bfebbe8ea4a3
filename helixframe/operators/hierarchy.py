"""Parent-child links of unknown depth: roots, depths, paths, descendants and cycles.

1. Terms with one parent make up fragments, trees below a head: a root, or a term with several parents.
2. The Euler tours of all fragments are built at once (successor of every arc) and ranked in parallel by
   pointer jumping, so the rounds grow with the logarithm of the nodes, not with the depth. Ranks give
   entry-exit intervals and depths. A tour that never ends runs below a ring of single parents.
3. A cycle that is no such ring passes through heads only by links into heads, so cycles are searched among
   heads (see :mod:`helixframe.operators.cycles`), which are few; the terms between are found from the
   intervals, in the sweep.
4. Sorted by entry and cut into blocks of bounded length, a sweep with a stack of open intervals writes the
   paths; a node is repeated in each block that its interval spans, which seeds the stack there. A
   fragment with a third of all nodes is thus many blocks.
5. Fragments under several parents are instantiated once for each path to their head. Descendants need
   no paths: they are the intervals, and the heads below them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from helixframe.operators.cycles import components
from helixframe.runtime import Table, materialize

#: Entries of one block of a tour.
BLOCK = 50_000
#: Siblings are ordered within this many hash buckets, so no window holds all children of a hot parent.
SIBLING_BUCKETS = 1024


def rank_tours(tree: DataFrame, trace: list | None = None) -> DataFrame:
    """Euler tours of a forest, ranked: ``v, head, sd, ud, depth``; nodes in or below a ring have no row.

    ``tree`` has one row ``(v, p)`` for each node with a parent. ``sd`` and ``ud`` count the entries
    from the node's entry, and after its exit, to the end of the tour: the subtree of v are the nodes
    x of its head with ``ud(v) < sd(x) <= sd(v)``.
    """
    return _tours(tree, trace)[0]


def _tours(tree: DataFrame, trace: list | None) -> tuple[DataFrame, bool]:
    """The ranked tours, and whether some nodes are left without one."""
    f = materialize(tree.withColumn("b", F.pmod(F.xxhash64("v"), F.lit(SIBLING_BUCKETS)).cast("int")), "forest")
    in_bucket = Window.partitionBy("p", "b").orderBy("v")
    s = f.withColumn("nx", F.lead("v").over(in_bucket)).withColumn("rn", F.row_number().over(in_bucket))
    over = Window.partitionBy("p").orderBy("b")  # at most SIBLING_BUCKETS rows
    firsts = s.where("rn = 1").select("p", "b", "v").withColumn("nb", F.lead("v").over(over)).withColumn("rb", F.row_number().over(over))
    nb = firsts.where("nb IS NOT NULL").select(F.col("p").alias("p2"), F.col("b").alias("b2"), "nb")
    sib = s.join(nb, (F.col("p") == F.col("p2")) & (F.col("b") == F.col("b2")), "left").select("v", "p", F.coalesce("nx", "nb").alias("sib"))
    fc = firsts.where("rb = 1").select(F.col("p").alias("fp"), F.col("v").alias("fc"))
    down = f.join(fc, F.col("v") == F.col("fp"), "left").select("v", F.lit(0).alias("d"), F.coalesce("fc", "v").alias("xv"), F.when(F.col("fc").isNull(), 1).otherwise(0).alias("xd"), F.lit(None).cast("bigint").alias("tail"))
    up_in = sib.where("sib IS NOT NULL").select("v", F.lit(1).alias("d"), F.col("sib").alias("xv"), F.lit(0).alias("xd"), F.lit(None).cast("bigint").alias("tail"))
    up = sib.where("sib IS NULL").join(f.select(F.col("v").alias("gv")), F.col("p") == F.col("gv"), "left")
    up_last = up.select("v", F.lit(1).alias("d"), F.col("gv").alias("xv"), F.when(F.col("gv").isNotNull(), 1).alias("xd"), F.when(F.col("gv").isNull(), F.col("p")).alias("tail"))
    arcs = down.union(up_in).union(up_last).select("*", (1 - F.col("d")).cast("bigint").alias("dn"), F.col("d").cast("bigint").alias("un"))
    pending = "count(xv)"
    r = Table(arcs, "rank", left=pending)
    before = -1
    # While a tour that ends is not ranked, every round ranks one of its arcs at least; rings never end.
    while r.seen["left"] and r.seen["left"] != before:
        x = r.df
        for i in range(3):  # three hops a round: every arc then sees four times as far
            y = r.df.select(*[F.col(c).alias(f"y{c}{i}") for c in r.df.columns])
            # Arcs that are ranked match no side (2) and are spread by their own node, not gathered as NULLs.
            j = x.join(y, (F.coalesce("xv", "v") == F.col(f"yv{i}")) & (F.coalesce("xd", F.lit(2)) == F.col(f"yd{i}")), "left")
            hop = F.col(f"yv{i}").isNotNull()
            x = j.select("v", "d", F.when(hop, F.col(f"yxv{i}")).alias("xv"), F.when(hop, F.col(f"yxd{i}")).alias("xd"), F.coalesce("tail", f"ytail{i}").alias("tail"),
                         (F.col("dn") + F.coalesce(f"ydn{i}", F.lit(0))).alias("dn"), (F.col("un") + F.coalesce(f"yun{i}", F.lit(0))).alias("un"))
        nxt = Table(x, "rank", left=pending)
        before = r.seen["left"]
        r.drop()
        r = nxt
        if trace is not None:
            trace.append(("rank", r.seen["left"]))
    at = lambda d, c: F.max(F.when(F.col("d") == d, F.col(c)))
    g = r.df.groupBy("v").agg(F.max("tail").alias("head"), at(0, "dn").alias("sd"), at(0, "un").alias("su"), at(1, "dn").alias("ud"))
    out = materialize(g.where("head IS NOT NULL").select("v", "head", "sd", "ud", (F.col("su") - F.col("sd") + 1).alias("depth")), "ranked")
    r.drop()
    return out, bool(r.seen["left"])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (head, block, sd descending): paths by a stack of open intervals."""
    key, stack = None, []
    for b in batches:
        out, size = [], 0
        for h, k, x, ud, sd, d, own in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
            if (h, k) != key:
                key, stack = (h, k), []
            while stack and stack[-1][0] >= sd:
                stack.pop()
            here = f"{stack[-1][1]}/{x}" if stack else str(x)
            stack.append((ud, here))
            if own:
                out.append((h, k, x, d, here))
                size += len(here)
            if size > 16_000_000:  # deep trees have long paths
                yield _path_batch(out)
                out, size = [], 0
        yield _path_batch(out)


def _path_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int64()] * 4 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["head", "block", "v", "depth", "rel"])


def _sweep_above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted alike, some with ``tags``: ``(v, tag)`` for the tagged rows and all open intervals around them."""
    key, stack = None, []
    for b in batches:
        vs, ts = [], []
        for h, k, x, ud, sd, own, tags in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
            if (h, k) != key:
                key, stack = (h, k), []
            while stack and stack[-1][0] >= sd:
                stack.pop()
            stack.append((ud, x, set()))
            for t in tags or () if own else ():
                for _, v, had in reversed(stack):
                    if t in had:
                        break  # and so have all above
                    had.add(t)
                    vs.append(v)
                    ts.append(t)
            if len(vs) > 500_000:
                yield _pairs(vs, ts)
                vs, ts = [], []
        yield _pairs(vs, ts)


def _sweep_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted alike: ``(v, tag)`` with the nodes ``tag`` inside the interval of v."""
    key, stack = None, []
    for b in batches:
        vs, ts = [], []
        for h, k, x, ud, sd, own in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if (h, k) != key:
                key, stack = (h, k), []
            while stack and stack[-1][0] >= sd:
                stack.pop()
            if own:
                vs += [v for _, v in stack]
                ts += [x] * len(stack)
            stack.append((ud, x))
            if len(vs) > 500_000:
                yield _pairs(vs, ts)
                vs, ts = [], []
        yield _pairs(vs, ts)


def _pairs(vs: list[int], ts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(vs, pa.int64()), pa.array(ts, pa.int64())], names=["v", "tag"])


@dataclass
class Forest:
    """Fragments and their tours, as written tables.

    ``terms``: ``id``; ``links``: ``child, parent``; ``ranked``: see :func:`rank_tours`, with the head's block
    length; ``heads``: ``v, is_root, n, blocks`` (n nodes without the head); ``head_links``: ``m, p, h`` for
    each link of a head m to a parent p in the fragment of h; ``cyclic``: ``id, label`` of heads on cycles, and of
    terms on rings of single parents.
    """

    terms: DataFrame
    ranked: DataFrame
    heads: DataFrame
    head_links: DataFrame
    cyclic: DataFrame
    block: int

    def rows(self, heads: DataFrame) -> DataFrame:
        """Nodes of the fragments of ``heads``, once for each block their interval spans: ``head, block, v, ud, sd, depth, own``."""
        b = lambda c: F.floor(c / F.lit(self.block))
        mine = self.ranked.join(heads.select(F.col("v").alias("hh")), F.col("head") == F.col("hh"), "left_semi")
        spans = mine.select("head", F.explode(F.sequence(b(F.col("ud")), b(F.col("sd") - 1))).alias("block"), "v", "ud", "sd", "depth").withColumn("own", F.col("block") == b(F.col("sd") - 1))
        tops = heads.select(F.col("v").alias("head"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "v", F.lit(0).cast("bigint").alias("ud"), (F.col("n") + 1).alias("sd"), F.lit(0).cast("bigint").alias("depth"), (F.col("blocks") - 1).alias("last"))
        return spans.unionByName(tops.withColumn("own", F.col("block") == F.col("last")).drop("last")).select("head", "block", "v", "ud", "sd", "depth", "own")

    def swept(self, rows: DataFrame, sweep, schema: str) -> DataFrame:
        return rows.repartition("head", "block").sortWithinPartitions("head", "block", F.desc("sd")).mapInArrow(sweep, schema)

    def above(self, heads: DataFrame, tags: DataFrame) -> DataFrame:
        """Distinct ``v, tag``: v lies on the way from the node of a tag (``at, tag``) up to its head, ends included."""
        t = tags.groupBy("at").agg(F.collect_set("tag").alias("tags"))
        r = self.rows(heads).join(t, F.col("v") == F.col("at"), "left").select("head", "block", "v", "ud", "sd", "own", "tags")
        return self.swept(r, _sweep_above, "v bigint, tag bigint").distinct()

    def open_heads(self) -> DataFrame:
        """Heads that lie on no cycle."""
        return self.heads.join(self.cyclic.select(F.col("id").alias("ci")), F.col("v") == F.col("ci"), "left_anti")


def forest(terms: DataFrame, links: DataFrame, *, block: int = BLOCK, trace: list | None = None) -> Forest:
    """Fragments, tours and cycles of ``terms`` (column ``id``) and ``links`` (``child, parent``).

    Repeats and NULLs are ignored, and links with an end that is no term.
    """
    t = materialize(terms.select(F.col("id").cast("bigint")).where("id IS NOT NULL").distinct(), "terms")
    raw = links.select(F.col("child").cast("bigint"), F.col("parent").cast("bigint")).where("child IS NOT NULL AND parent IS NOT NULL").distinct()
    lk = materialize(raw.join(t.withColumnRenamed("id", "x"), F.col("parent") == F.col("x"), "left_semi").join(t.withColumnRenamed("id", "y"), F.col("child") == F.col("y"), "left_semi"), "links")
    deg = lk.groupBy("child").agg(F.count(F.lit(1)).alias("k"), F.min("parent").alias("p"))
    nodes = materialize(t.join(deg, F.col("id") == F.col("child"), "left").select(F.col("id").alias("v"), F.coalesce("k", F.lit(0)).alias("k"), "p"), "nodes")
    single = nodes.where("k = 1").select("v", "p")
    ranked, loose = _tours(single, trace)
    size = ranked.groupBy(F.col("head").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    heads = nodes.where("k != 1").join(size, F.col("v") == F.col("h"), "left").select("v", (F.col("k") == 0).alias("is_root"), F.coalesce("n", F.lit(0)).alias("n"))
    heads = materialize(heads.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / block))), "heads")
    several = heads.where("NOT is_root").select(F.col("v").alias("m"))
    at = ranked.select(F.col("v").alias("a"), "head").union(heads.select("v", "v"))
    into = lk.join(several, F.col("child") == F.col("m"), "left_semi").join(at, F.col("parent") == F.col("a"))
    head_links = materialize(into.select(F.col("child").alias("m"), F.col("parent").alias("p"), F.col("head").alias("h")), "head_links")
    up = head_links.join(several.withColumnRenamed("m", "s"), F.col("h") == F.col("s"), "left_semi").select(F.col("m").alias("child"), F.col("h").alias("parent"))
    if loose:  # rings of single parents, and what hangs below them
        up = up.union(single.join(ranked.select(F.col("v").alias("r")), F.col("v") == F.col("r"), "left_anti").select("v", "p"))
    return Forest(t, ranked, heads, head_links, components(up, trace), block)


def _on_cycles(f: Forest) -> DataFrame:
    """Distinct ``id`` of all terms on cycles."""
    a, b = f.cyclic.select(F.col("id").alias("a"), F.col("label").alias("la")), f.cyclic.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    inner = f.head_links.join(a, F.col("m") == F.col("a")).join(b, F.col("h") == F.col("b")).where("la = lb")
    on = f.above(f.heads.join(b, F.col("v") == F.col("b"), "left_semi"), inner.select(F.col("p").alias("at"), F.lit(0).cast("bigint").alias("tag")))
    return materialize(on.select(F.col("v").alias("id")).union(f.cyclic.select("id")).distinct(), "cycles")


def _instances(heads: DataFrame, steps: DataFrame, trace: list | None) -> DataFrame:
    """One row per path from a root to a head: ``v, root, lvl, prefix, blocks``; three heads further down a round.

    Rounds start at roots, so no table holds more paths than the result.
    """
    s = steps.select("ph", "pb", "m", "plus", "rel", F.col("blocks").alias("nb"))
    wide = lambda d: _spread(d).join(s, (F.col("v") == F.col("ph")) & (F.col("blk") == F.col("pb"))).select(F.col("m").alias("v"), "root", (F.col("lvl") + F.col("plus")).alias("lvl"), F.concat("prefix", "rel").alias("prefix"), F.col("nb").alias("blocks"))
    nth = lambda d, i: d.select("*", F.lit(i).alias("nth"))
    first = heads.where("is_root").select("v", F.col("v").alias("root"), F.lit(0).cast("bigint").alias("lvl"), F.lit("").alias("prefix"), "blocks")
    t = Table(nth(first, 3), "inst", last="count_if(nth = 3)")
    schema, written = t.df.schema, [t.path]
    while t.seen["last"]:
        one = wide(t.df.where("nth = 3").drop("nth"))
        two = wide(one)
        t = Table(nth(one, 1).union(nth(two, 2)).union(nth(wide(two), 3)), "inst", last="count_if(nth = 3)")
        written.append(t.path)
        if trace is not None:
            trace.append(("paths", t.seen["last"]))
    return t.spark.read.schema(schema).parquet(*written).drop("nth")  # one scan, however many rounds


def _spread(d: DataFrame) -> DataFrame:
    return d.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


def hierarchy(terms: DataFrame, links: DataFrame, *, block: int = BLOCK, tours: Forest | None = None, trace: list | None = None) -> DataFrame:
    """Every path from a root to a term: ``id, node_state, root_id, lvl, full_path``.

    ``terms`` has a column ``id`` (repeats and NULLs are ignored), ``links`` the columns ``child,
    parent``; links with a NULL or an end that is no term are ignored, repeats count once. State
    ``tree``: one row per distinct path through terms off all cycles; ``on_cycle`` and
    ``below_cycle`` (no such path): one row with root and level -1 and an empty path. Empty inputs
    give no rows; without links every term is a root. ``tours``: the :func:`forest` of the same tables, if
    it has been built.
    """
    f = tours or forest(terms, links, block=block, trace=trace)
    cyc = _on_cycles(f)
    heads = f.open_heads()
    paths = materialize(f.swept(f.rows(heads), _sweep, "head bigint, block bigint, v bigint, depth bigint, rel string"), "paths")
    # Links into heads with several parents, with the path inside the parent's fragment.
    he = f.head_links.join(paths, F.col("p") == F.col("v")).join(heads.select(F.col("v").alias("hv"), "blocks"), F.col("m") == F.col("hv"))
    he = materialize(he.select(F.col("head").alias("ph"), F.col("block").alias("pb"), "m", (F.col("depth") + 1).alias("plus"), F.concat("rel", F.lit("/")).alias("rel"), "blocks"), "steps")
    inst = _instances(heads, he, trace)
    at = _spread(inst).withColumnRenamed("v", "iv")
    tree = paths.join(at, (F.col("head") == F.col("iv")) & (F.col("block") == F.col("blk"))).select(
        F.col("v").alias("id"), F.lit("tree").alias("node_state"), F.col("root").alias("root_id"), (F.col("lvl") + F.col("depth")).cast("int").alias("lvl"), F.concat("prefix", "rel").alias("full_path"))
    none = lambda d, s: d.select("id", F.lit(s).alias("node_state"), F.lit(-1).cast("bigint").alias("root_id"), F.lit(-1).alias("lvl"), F.lit("").alias("full_path"))
    reached = inst.select(F.col("v").alias("iv")).distinct()
    placed = paths.select("v", "head").join(reached, F.col("head") == F.col("iv"), "left_semi").select("v").union(cyc)
    below = f.terms.join(placed, F.col("id") == F.col("v"), "left_anti")
    return tree.union(none(cyc, "on_cycle")).union(none(below, "below_cycle"))


def _heads_below(f: Forest) -> tuple[DataFrame, DataFrame]:
    """Open heads that a root leads to, and distinct ``v, m``: the heads m below each of their terms v.

    Which heads lie below a head is closed by doubling, so rounds grow with the logarithm of the depth.
    """
    heads = f.open_heads()
    ok = heads.select(F.col("v").alias("o"))
    links = materialize(f.head_links.join(ok, F.col("m") == F.col("o"), "left_semi").join(ok.withColumnRenamed("o", "q"), F.col("h") == F.col("q"), "left_semi"), "open_links")
    rows = "count(1)"
    r = Table(links.select("h", "m").distinct(), "closure", n=rows)
    while True:
        a, b = r.df, r.df.select(F.col("h").alias("bh"), F.col("m").alias("bm"))
        nxt = Table(a.union(a.join(b, F.col("m") == F.col("bh")).select("h", "bm")).distinct(), "closure", n=rows)
        same = nxt.seen["n"] == r.seen["n"]
        r.drop()
        r = nxt
        if same:
            break
    root = heads.where("is_root").select("v")
    led = materialize(heads.join(root.union(r.df.join(root, F.col("h") == F.col("v"), "left_semi").select(F.col("m").alias("v"))).distinct(), "v", "left_semi"), "led")
    first = materialize(f.above(led, links.select(F.col("p").alias("at"), F.col("m").alias("tag"))), "first_heads")
    far = first.join(r.df, F.col("tag") == F.col("h")).select("v", "m")
    return led, materialize(first.select("v", F.col("tag").alias("m")).union(far).distinct(), "heads_below")


def descendants(terms: DataFrame, links: DataFrame, *, block: int = BLOCK, tours: Forest | None = None) -> DataFrame:
    """Distinct pairs ``(ancestor, id)`` over the terms that :func:`hierarchy` puts into a ``tree`` (a term is not its own).

    Terms inside the entry-exit interval of the ancestor, the heads below it, and the fragments of those.
    Each pair comes from one of the three, so only pairs with heads are made distinct.
    """
    f = tours or forest(terms, links, block=block)
    led, below = _heads_below(f)
    rows = f.rows(led).select("head", "block", "v", "ud", "sd", "own")
    inside = f.swept(rows, _sweep_within, "v bigint, tag bigint").select(F.col("v").alias("ancestor"), F.col("tag").alias("id"))
    whole = below.join(f.ranked.select("head", F.col("v").alias("id")), F.col("m") == F.col("head")).select(F.col("v").alias("ancestor"), "id")
    return inside.union(below.select(F.col("v").alias("ancestor"), F.col("m").alias("id"))).union(whole)


def descendant_counts(terms: DataFrame, links: DataFrame, *, block: int = BLOCK, tours: Forest | None = None) -> DataFrame:
    """``id, n_descendants`` of the terms that have any, without making the pairs: lengths of intervals, and sizes of the fragments below."""
    f = tours or forest(terms, links, block=block)
    led, below = _heads_below(f)
    own = led.select(F.col("v").alias("id"), "n").union(f.ranked.join(led.select(F.col("v").alias("lv")), F.col("head") == F.col("lv"), "left_semi").select("v", F.col("sd") - F.col("ud") - 1))
    more = below.join(f.heads.select(F.col("v").alias("hv"), "n"), F.col("m") == F.col("hv")).select(F.col("v").alias("id"), F.col("n") + 1)
    return own.union(more).groupBy("id").agg(F.sum("n").alias("n_descendants")).where("n_descendants > 0")
