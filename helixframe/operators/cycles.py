"""Strongly connected components of a table of links ``child, parent``, and what lies on cycles.

Every round makes the graph smaller and remembers how to put back what it took off:

1. Peeling: links whose child has no children or whose parent has no parents lie on no cycle.
2. Contraction: terms with a single parent form trees (and single rings). Pointer jumping finds the top
   of every such term in a number of rounds that grows with the logarithm of the way up; links into a
   tree then lead to its top, and only terms with several parents are left.
3. Where neither takes off a tenth of the links, components are told apart by colouring: the largest
   reachable id (ids that have been reached lend theirs, so colours travel in jumps), then reach within
   one colour.

Afterwards the trees are put back, the last first: a term of a tree lies on a cycle if a way up from a
link into the tree runs through it and both ends of that link belong to one component. Those ways are
marked by doubling, with the jumps of step 2. On chains, trees and what contracts to them the rounds
are logarithmic; wide ladders (every term with several parents, over many layers) take a round for
every four layers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helixframe.runtime import Table, materialize

_ROWS = "count(1)"
#: Rounds of :func:`longest_ways` that contract only if an eighth of the open terms have one open parent.
PLAIN_ROUNDS = 20


def _to(x: Column, at: Column, on: Column) -> tuple[Column, str]:
    """Left join of the rows with ``x``; those without match nothing, but are spread by their own id and not gathered as NULLs."""
    return (F.coalesce(x, F.col("v")) == at) & (x.isNotNull() == on), "left"


class Jumps:
    """Pointer jumping over terms with one parent.

    ``steps[i]`` maps ``v`` to ``x``, the term 4**i links up if it has a single parent itself, else
    ``top`` is the first term that has not. ``rings`` are the terms of rings with the least id as label.
    With ``weighted`` the links carry ``w`` and ``b``, and so do the steps: the value of v is
    ``max(b, w + value of its top)``.
    """

    def __init__(self, single: DataFrame, trace: list | None = None, *, weighted: bool = False):
        extra = ["w", "b"] if weighted else []
        f = single.select("v", "p", *extra)
        y = f.select(F.col("v").alias("yv"))
        first = f.join(y, F.col("p") == F.col("yv"), "left").select("v", F.col("yv").alias("x"), F.when(F.col("yv").isNull(), F.col("p")).alias("top"), F.col("v").alias("lo"), *extra)
        pending = "count(x)"
        self.steps = [Table(first, "jump", n=_ROWS, left=pending)]
        seen = self.steps[0].seen
        reach = 1
        while seen["left"] and reach <= seen["left"]:
            now = self.steps[-1]
            j = now.df
            for i in range(3):
                z = now.df.select(*[F.col(c).alias(f"z{c}{i}") for c in ("v", "x", "top", "lo", *extra)], F.lit(True).alias(f"zon{i}"))
                more = [(F.col("w") + F.coalesce(f"zw{i}", F.lit(0))).alias("w"), F.greatest("b", F.col("w") + F.col(f"zb{i}")).alias("b")] if weighted else []
                j = j.join(z, *_to(F.col("x"), F.col(f"zv{i}"), F.col(f"zon{i}"))).select("v", F.col(f"zx{i}").alias("x"), F.coalesce("top", f"ztop{i}").alias("top"), F.least("lo", f"zlo{i}").alias("lo"), *more)
            self.steps.append(Table(j, "jump", n=_ROWS, left=pending))
            seen = self.steps[-1].seen
            reach *= 4
            if trace is not None:
                trace.append(("jump", seen["left"]))
        self.last = self.steps[-1].df
        self.has_rings = bool(seen["left"])

    @property
    def tops(self) -> DataFrame:
        """``v, top`` of the terms that have a top."""
        return self.last.where("top IS NOT NULL").select("v", "top")

    @property
    def rings(self) -> DataFrame:
        """``id, label``: after as many links as there are terms left, every way has entered its ring."""
        on = self.last.where("x IS NOT NULL").select(F.col("x").alias("r")).distinct()
        return self.last.join(on, F.col("v") == F.col("r"), "left_semi").select(F.col("v").alias("id"), F.col("lo").alias("label"))

    def ways_up(self, marked: DataFrame) -> DataFrame:
        """``id, label`` of all terms on the ways from the marked ones (``id, label``) to their tops."""
        m = Table(marked.distinct(), "marks", n=_ROWS)
        for step in self.steps if m.seen["n"] else ():
            if not step.seen["left"]:
                continue
            s = step.df.where("x IS NOT NULL").select("v", "x")
            cur, out = m.df, m.df
            for _ in range(3):
                cur = cur.join(s, F.col("id") == F.col("v")).select(F.col("x").alias("id"), "label").distinct()
                out = out.union(cur)
            nxt = Table(out.distinct(), "marks")
            m.drop()
            m = nxt
        return m.df


def _peeled(e: DataFrame) -> DataFrame:
    kids, parents = e.select(F.col("child").alias("k")).distinct(), e.select(F.col("parent").alias("q")).distinct()
    return e.join(parents, e.child == F.col("q"), "left_semi").join(kids, e.parent == F.col("k"), "left_semi")


def _coloured(e: DataFrame, trace: list | None) -> DataFrame:
    """``id, label`` of the members of at least one component of every weakly connected part."""
    ids = e.select(F.col("child").alias("id")).union(e.select("parent")).distinct()
    ups = "count_if(up)"
    colour = Table(ids.select("id", F.col("id").alias("c"), F.lit(True).alias("up")), "colour", n=ups)
    while colour.seen["n"]:
        c = colour.df
        far = c.select(F.col("id").alias("fi"), F.col("c").alias("fc"))
        hop = c.select("id", "c").join(far, F.col("c") == F.col("fi")).select("id", "c", "fc")  # the colour of the term that lent the colour
        seen = e.join(c, e.parent == F.col("id")).groupBy(F.col("child").alias("i2")).agg(F.max("c").alias("c2"))
        best = F.greatest("c", "fc", "c2")
        nxt = Table(hop.join(seen, F.col("id") == F.col("i2"), "left").select("id", best.alias("c"), (best > F.col("c")).alias("up")), "colour", n=ups)
        colour.drop()
        colour = nxt
        if trace is not None:
            trace.append(("colour", colour.seen["n"]))
    c1, c2 = colour.df.select(F.col("id").alias("a"), F.col("c").alias("ca")), colour.df.select(F.col("id").alias("b"), F.col("c").alias("cb"))
    inner = Table(e.join(c1, e.child == F.col("a")).join(c2, e.parent == F.col("b")).where("ca = cb").select("child", "parent", F.col("ca").alias("label")), "inner")
    reach = Table(colour.df.where("id = c").select("id", F.col("c").alias("label"), F.lit(True).alias("new")), "reach", n=_ROWS)
    while reach.seen["n"]:  # what the term that gave the colour reaches within it
        r = reach.df
        step = inner.df.select("child", "parent").join(r.where("new"), F.col("child") == F.col("id"), "left_semi").select(F.col("parent").alias("s")).distinct()
        fresh = step.join(r, F.col("s") == F.col("id"), "left_anti").join(colour.df, F.col("s") == F.col("id")).select("id", F.col("c").alias("label"), F.lit(True).alias("new"))
        nxt = Table(r.select("id", "label", F.lit(False).alias("new")).union(fresh), "reach", n="count_if(new)")
        reach.drop()
        reach = nxt
        if trace is not None:
            trace.append(("reach", reach.seen["n"]))
    out = materialize(reach.df.select("id", "label"), "members")
    for t in (colour, inner, reach):
        t.drop()
    return out


def components(links: DataFrame, trace: list | None = None) -> DataFrame:
    """``id, label`` of every term from which links lead back to it, also in one step.

    Terms share a label if and only if links lead from each to the other. Links with a NULL end are
    ignored, repeats count once; an empty table gives no row. ``trace`` receives one entry a round.
    """
    e = _links(links.where("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct())
    done, used = [], [e]
    while e.seen["n"]:
        if e.seen["loops"]:
            done.append(("loops", e.df.where("child = parent").select(F.col("child").alias("id")).distinct()))
        n0 = e.seen["n"] - e.seen["loops"]
        peeled = Table(_peeled(_peeled(e.df.where("child != parent").select("child", "parent").distinct())), "peel", n=_ROWS)
        used.append(peeled)
        n = peeled.seen["n"]
        if trace is not None:
            trace.append(("peel", n))
        if not n:
            break
        deg = peeled.df.groupBy(F.col("child").alias("v")).agg(F.count(F.lit(1)).alias("k"), F.min("parent").alias("p"))
        jumps = Jumps(deg.where("k = 1"), trace)
        used += jumps.steps
        single = jumps.steps[0].seen["n"]
        if 10 * (n0 - n + single) < n0:
            members = _coloured(peeled.df, trace)
            done.append(("core", members))
            m1, m2 = members.select(F.col("id").alias("a")), members.select(F.col("id").alias("b"))
            e = _links(peeled.df.join(m1, F.col("child") == F.col("a"), "left_anti").join(m2, F.col("parent") == F.col("b"), "left_anti"))
        else:
            in_tree = jumps.last.select(F.col("v").alias("t"), "top")
            from_several = peeled.df.join(jumps.last.select(F.col("v").alias("s")), F.col("child") == F.col("s"), "left_anti")
            to = from_several.join(in_tree, F.col("parent") == F.col("t"), "left").where("t IS NULL OR top IS NOT NULL")
            e = _links(to.select("child", F.coalesce("top", "parent").alias("parent"), F.when(F.col("t").isNotNull(), F.col("parent")).alias("at")))
            done.append(("tree", e.df.where("at IS NOT NULL"), jumps))
            if jumps.has_rings:
                done.append(("core", jumps.rings))
        used.append(e)
    labels = None
    for kind, x, *jumps in reversed(done):
        if kind == "loops":
            x = x if labels is None else x.join(labels.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_anti")
            x = x.select("id", F.col("id").alias("label"))
        elif kind == "tree":
            if labels is None:
                continue
            known = Table(labels, "labels")
            used.append(known)
            labels = known.df
            a, b = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
            marked = x.join(a, F.col("child") == F.col("a")).join(b, F.col("parent") == F.col("b")).where("la = lb").select(F.col("at").alias("id"), F.col("la").alias("label"))
            x = jumps[0].ways_up(marked)
        labels = x if labels is None else labels.union(x)
    if labels is None:
        labels = e.df.where(F.lit(False)).select(F.col("child").alias("id"), F.col("parent").alias("label"))
    out = materialize(labels, "components")
    for t in used:
        t.drop()
    return out


def _links(df: DataFrame) -> Table:
    return Table(df, "links", n=_ROWS, loops="count_if(child = parent)")


def cycle_terms(links: DataFrame, trace: list | None = None) -> DataFrame:
    """Terms (one column ``id``) from which links lead back to themselves, also in one step."""
    return components(links, trace).select("id")


def longest_ways(links: DataFrame, trace: list | None = None) -> tuple[DataFrame, DataFrame]:
    """``v, level``: links of the longest way up from every child; and the links no level could be given to.

    One value a term is kept. Every round settles the terms whose parents are settled and contracts terms
    with one open parent by weighted pointer jumping, so rounds do not grow with the length of single
    ways; while such terms are few, the first ``PLAIN_ROUNDS`` rounds do without. What is left are the links of terms on or below cycles.
    """
    lk = links.where("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct()
    is_open = "count(parent)"
    # A row without a parent holds the longest way through parents that are settled.
    e = Table(lk.select("child", "parent", F.lit(1).cast("bigint").alias("w")), "ways", n=is_open)
    settled, trees, used, rounds = [], [], [e], 0
    while True:
        up = F.col("parent").isNotNull()
        g = Table(e.df.groupBy(F.col("child").alias("v")).agg(F.count("parent").alias("k"), F.max("parent").alias("p"), F.max(F.when(up, F.col("w"))).alias("w"), F.coalesce(F.max(F.when(~up, F.col("w"))), F.lit(0)).alias("b")), "terms", one="count_if(k = 1)", some="count_if(k > 0)")
        used.append(g)
        settled.append(g.df.where("k = 0").select("v", F.col("b").alias("level")))
        if not e.seen["n"]:
            break
        x = e.df
        rounds += 1
        if g.seen["one"] and (8 * g.seen["one"] >= g.seen["some"] or rounds > PLAIN_ROUNDS):
            jumps = Jumps(g.df.where("k = 1"), trace, weighted=True)
            used += jumps.steps
            t = jumps.last.where("top IS NOT NULL").select(F.col("v").alias("t"), "top", F.col("w").alias("tw"), F.col("b").alias("tb"))
            trees.append(t)
            x = x.join(t.select(F.col("t").alias("own")), F.col("child") == F.col("own"), "left_anti").join(t, F.col("parent") == F.col("t"), "left")
            both = F.array(F.struct(F.coalesce("top", "parent").alias("parent"), (F.col("w") + F.coalesce("tw", F.lit(0))).alias("w")), F.struct(F.lit(None).cast("bigint").alias("parent"), (F.col("w") + F.col("tb")).alias("w")))
            x = x.select("child", F.explode(F.filter(both, lambda s: s["w"].isNotNull())).alias("s")).select("child", "s.parent", "s.w")
        at = g.df.select(F.col("v").alias("a"), F.col("k").alias("ak"), F.col("b").alias("ab"))
        x = x.where(up).join(at, F.col("parent") == F.col("a"), "left").union(x.where(~up).select("child", "parent", "w", *[F.lit(None).cast("bigint")] * 3))
        free = F.coalesce("ak", F.lit(0)) == 0
        x = x.select("child", F.when(~free, F.col("parent")).alias("parent"), (F.col("w") + F.when(free, F.coalesce("ab", F.lit(0))).otherwise(0)).alias("w"))
        was_settled = g.df.where("k = 0").select(F.col("v").alias("s"))
        x = x.join(was_settled, F.col("child") == F.col("s"), "left_anti")
        nxt = Table(x.groupBy("child", "parent").agg(F.max("w").alias("w")), "ways", n=is_open)
        used.append(nxt)
        if trace is not None:
            trace.append(("ways", nxt.seen["n"]))
        stuck = nxt.seen["n"] == e.seen["n"]
        e = nxt
        if stuck:
            break
    known = settled[0]
    for s in settled[1:]:
        known = known.union(s)
    known = Table(known, "levels")
    kids = lk.select(F.col("child").alias("kid")).distinct()
    for t in reversed(trees):
        k = known.df.select(F.col("v").alias("kv"), F.col("level").alias("kl"))
        # A top without links has level 0; one that has links but no level is left open, and its tree with it.
        at = t.join(k, F.col("top") == F.col("kv"), "left").join(kids, F.col("top") == F.col("kid"), "left").where("kv IS NOT NULL OR kid IS NULL")
        nxt = Table(known.df.union(at.select(F.col("t").alias("v"), F.greatest("tb", F.col("tw") + F.coalesce("kl", F.lit(0))).alias("level"))), "levels")
        known.drop()
        known = nxt
    rest = materialize(lk.join(known.df.select(F.col("v").alias("kv")), F.col("child") == F.col("kv"), "left_anti"), "rest")
    for t in used:
        t.drop()
    return known.df, rest
