import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators.cycles import components, cycle_terms
from helixframe.operators.hierarchy import descendant_counts, descendants, forest, hierarchy, rank_tours


def brute(terms, links):
    t = {x for x in terms if x is not None}
    par = {}
    for c, p in links:
        if c in t and p in t:
            par.setdefault(c, set()).add(p)

    def reach(v):
        st, seen = list(par.get(v, ())), set(par.get(v, ()))
        while st:
            for y in par.get(st.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    st.append(y)
        return seen

    cyc = {v for v in t if v in reach(v)}
    memo = {}

    def paths(v):
        if v not in memo:
            memo[v] = [] if v in cyc else [str(v)] if v not in par else [f"{q}/{v}" for p in par[v] for q in paths(p)]
        return memo[v]

    out = []
    for v in t:
        if v in cyc:
            out.append((v, "on_cycle", -1, -1, ""))
        elif not paths(v):
            out.append((v, "below_cycle", -1, -1, ""))
        else:
            out += [(v, "tree", int(q.split("/")[0]), q.count("/"), q) for q in paths(v)]
    return sorted(out)


def graph(n, seed):
    rng = random.Random(seed)
    links = [(i, rng.randrange(max(0, i - 8), i)) for i in range(1, n) if rng.random() < 0.9]
    links += [(i, rng.randrange(i)) for i in range(1, n) if rng.random() < 0.06]
    links += [(i, i) for i in (5, 17)] + [(10, 30), (30, 31), (31, 10), (4, 999), (None, 3), (3, None), (999, 2)]
    return list(range(n)) + [7, None], links + links[:5]


def tables(spark, terms, links):
    t = spark.createDataFrame([(x, "c") for x in terms], "id bigint, child string")
    return t, spark.createDataFrame(links, "child bigint, parent bigint")


def run(spark, terms, links, **kw):
    return hierarchy(*tables(spark, terms, links), **kw)


@pytest.mark.parametrize("block", [50_000, 3])
def test_random_graphs(spark, block):
    terms, links = graph(70, 4)
    f = forest(*tables(spark, terms, links), block=block)
    got = sorted(map(tuple, hierarchy(None, None, tours=f).collect()))
    assert got == brute(terms, links)
    below(f, got)


def below(f, rows):
    """Descendants and their counts, against the paths."""
    want = {(int(a), r[0]) for r in rows for a in r[4].split("/")[:-1] if a}
    got = [tuple(r) for r in descendants(None, None, tours=f).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    n = {}
    for a, _ in want:
        n[a] = n.get(a, 0) + 1
    assert {r[0]: r[1] for r in descendant_counts(None, None, tours=f).collect()} == n


def test_chain_star_and_no_links(spark):
    n = 60
    terms = list(range(2 * n))
    links = [(i, i - 1) for i in range(1, n)] + [(i, 3) for i in range(n, 2 * n)]
    f = forest(*tables(spark, terms, links), block=5)
    rows = sorted(map(tuple, hierarchy(None, None, tours=f).collect()))
    assert rows == brute(terms, links)
    below(f, rows)
    assert sorted(map(tuple, run(spark, [1, 2], []).collect())) == brute([1, 2], [])
    assert run(spark, [], []).count() == 0
    assert descendants(*tables(spark, [], [])).count() == 0


def strong(links):
    """Components by brute force: sets of terms that reach each other, those on no cycle left out."""
    par = {}
    for c, p in links:
        par.setdefault(c, set()).add(p)
    reach = {}
    for v in {x for e in links for x in e}:
        st, seen = list(par.get(v, ())), set(par.get(v, ()))
        while st:
            for y in par.get(st.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    st.append(y)
        reach[v] = seen
    return {frozenset({v} | {w for w in reach[v] if v in reach[w]}) for v in reach if v in reach[v]}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    """Rings, trees into rings, dense cores, and rings joined by chains."""
    rng = random.Random(seed)
    n, m = [(40, 45), (60, 150), (30, 33), (80, 84)][seed]
    links = list({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
    ring = lambda at, k: [(at + i, at + (i + 1) % k) for i in range(k)]
    links += ring(100, 7) + [(120, 103), (121, 120), (103, 130), (130, 131), (131, 105)] + ring(200, 3) + [(202, 101), (300, 300)]
    got = {}
    for r in components(spark.createDataFrame(links, "child bigint, parent bigint")).collect():
        got.setdefault(r.label, set()).add(r.id)
    assert {frozenset(v) for v in got.values()} == strong(links)


def test_wide_ladders_and_coloured_cores(spark):
    """Nothing to peel and no single parents: colouring, with two components joined by one link."""
    grid = lambda at, k: [(at + i, at + (i + d) % k) for i in range(k) for d in (1, 3)]
    links = grid(0, 12) + grid(50, 9) + [(3, 52), (60 + 40, 0), (100, 5)]
    trace = []
    got = {}
    for r in components(spark.createDataFrame(links, "child bigint, parent bigint"), trace).collect():
        got.setdefault(r.label, set()).add(r.id)
    assert {frozenset(v) for v in got.values()} == strong(links)
    assert any(k == "colour" for k, _ in trace)


def test_rounds_grow_with_the_logarithm(spark):
    """A chain of a million links: the cycle search and the tour take rounds of about log4 of its length."""
    n = 1_000_000
    chain = spark.range(1, n + 1).selectExpr("(id * 7919) % 1000003 AS child", "((id - 1) * 7919) % 1000003 AS parent")
    trace = []
    assert cycle_terms(chain, trace).count() == 0
    assert len(trace) <= 14
    n = 200_000
    chain = chain.limit(0).union(spark.range(1, n + 1).selectExpr("(id * 7919) % 1000003", "((id - 1) * 7919) % 1000003"))
    trace = []
    r = rank_tours(chain.selectExpr("child AS v", "parent AS p"), trace)
    assert r.agg(F.max("depth"), F.count("v")).first() == (n, n)
    assert len(trace) <= 12


def test_tours_nest(spark):
    tree = spark.createDataFrame([(i, (i - 1) // 3) for i in range(1, 50)], "v bigint, p bigint")
    r = {x.v: x for x in rank_tours(tree).collect()}
    for v, x in r.items():
        sub = {y for y, z in r.items() if x.ud < z.sd <= x.sd}
        want = {v} | {y for y in r if any(a == v for a in anc(y))}
        assert sub == want and x.head == 0 and x.depth == len(anc(v))
    assert rank_tours(tree.where(F.lit(False))).count() == 0


def anc(v):
    out = []
    while v:
        v = (v - 1) // 3
        out.append(v)
    return out
