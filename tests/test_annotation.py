import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import annotation as an, contacts as hc
from helixframe.sources import formats as fm

GTF = """#!genome
chr1\tH\tgene\t1001\t2000\t.\t+\t.\tgene_id "G1"; gene_name "A";
chr1\tH\tGene\t1\t9\t.\t-\t.\tgene_id "G1"; gene_name "second";
chr1\tH\ttranscript\t1001\t1900\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; transcript_type "protein_coding";
chr1\tH\ttranscript\t1101\t2000\t.\t+\t.\tgene_id "G1"; transcript_id "T2"; transcript_type "lncRNA";
chr1\tH\texon\t1001\t1100\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
chr1\tH\texon\t1001\t1100\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
chr1\tH\tUTR\t1001\t1010\t.\t+\t.\ttranscript_id "T1";
chr1\tH\tfive_prime_utr\t1001\t1010\t.\t+\t.\ttranscript_id "T1";
chr1\tH\texon\t5\t6\t.\t+\t.\ttranscript_id "orphan";
chr2\tH\tgene\t11\t500\t.\t-\t.\tgene_id "G2"; gene_name "B";"""


def genes(spark):
    return an.gene_models(fm.gtf_elements(spark.createDataFrame([(x, i) for i, x in enumerate(GTF.split("\n"))], "value string, line_no bigint")))


def test_gene_models(spark):
    g = {r.gene_id: r for r in genes(spark).collect()}
    assert set(g) == {"G1", "G2"} and g["G1"].gene_name == "A" and (g["G1"].left, g["G1"].right_incl) == (1000, 1999) and g["G2"].transcripts == []
    t = {x.transcript_id: x for x in g["G1"].transcripts}
    assert [tuple(e) for e in t["T1"].exons] == [(1000, 1099)] and [tuple(e) for e in t["T1"].utrs] == [(1000, 1009)] and t["T1"].coding and not t["T2"].coding
    with pytest.raises(Exception, match="no gene_name"):
        fm.gtf_elements(spark.createDataFrame([('c\tH\tgene\t1\t2\t.\t+\t.\tgene_id "x";', 0)], "value string, line_no bigint")).collect()


def test_promoters_and_domains(spark):
    p = an.promoters(genes(spark), 500, 100)
    assert sorted((r.chrom, r.chrom_start, r.chrom_end, r.tss) for r in p.collect()) == [("chr1", 500, 1100, 1000), ("chr1", 600, 1200, 1100), ("chr2", 399, 999, 499)]
    rng = random.Random(1)
    rows = [(f"c{i % 3}", s, s + 50, f"g{i}") for i, s in enumerate(rng.randrange(20_000) for _ in range(60))]
    df = spark.createDataFrame(rows, "chrom string, chrom_start bigint, chrom_end bigint, gene_name string")
    s = sorted(rows)
    want, third = [], []
    for i, (c, a, z, g) in enumerate(s):
        left = s[i - 1][2] if i and s[i - 1][0] == c else None
        right = s[i + 1][1] if i + 1 < len(s) and s[i + 1][0] == c else None
        lo = max(a - 300, 0) if left is None else min(a, max(a - 300, left))
        hi = z + 300 if right is None else max(z, min(z + 300, right))
        d = [x for x in ((c, lo, a, g), (c, z, hi, g)) if x[2] > x[1]]
        want += d
        third += d if i % 3 == 0 else []
    assert sorted(map(tuple, an.regulatory_domains(df, 300, "gene_name").collect())) == sorted(want)
    assert sorted(map(tuple, an.regulatory_domains(df, 300, "gene_name", every_third=True).collect())) == sorted(third)


def test_levels_and_enrichment(spark):
    lk = spark.createDataFrame([(3, 2), (2, 1), (3, 1), (5, 99), (3, 2), (None, 1)], "child bigint, parent bigint")
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 77)], "id bigint")
    assert {r.id: r.level for r in an.go_levels(ids, lk).collect()} == {1: 0, 2: 1, 3: 2, 5: 1, 77: 0}
    with pytest.raises(ValueError):
        an.go_levels(ids, spark.createDataFrame([(1, 2), (2, 1)], lk.schema))
    a = spark.createDataFrame([(i, "t" if i < 5 else "u") for i in range(20)] + [(0, "u"), (0, "t")], "item int, term string")
    fg = spark.createDataFrame([(i,) for i in (0, 1, 2, 9, 9, 50)], "item int")
    r = {x.term: x for x in an.enrichment(a, fg).collect()}
    assert (r["t"].x, r["t"].m, r["t"].n, r["t"].total) == (3, 5, 4, 20) and r["t"].fold_change == pytest.approx(3.0)
    assert r["t"].p_value == pytest.approx((10 * 15 + 5) / 4845)


def test_levels_of_terms_with_cycles(spark):
    lk = spark.createDataFrame([(3, 2), (2, 1), (3, 1), (5, 99), (99, 1), (6, 7), (7, 6), (8, 6), (8, 1), (9, 9), (4, 8), (None, 1), (1, None)], "child bigint, parent bigint")
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 9, None)], "id bigint")
    got = {r.id: (r.node_state, r.level) for r in an.term_levels(ids, lk).collect()}
    assert got == {1: ("free", 0), 2: ("free", 1), 3: ("free", 2), 5: ("free", 1), **{i: ("on_cycle", -1) for i in (6, 7, 9)}, **{i: ("below_cycle", -1) for i in (4, 8)}}


def test_contacts(spark):
    pairs = [(1, 2), (2, 1), (2, 2), (2, 2), (2, 2), (0, 5)]
    m = hc.contact_map(spark.createDataFrame(pairs, "bin1 int, bin2 int"))
    assert {(r.i, r.j): r.value for r in m.collect()} == {(1, 2): 1, (2, 2): 1, (0, 5): 0}
    d = hc.contact_map(spark.createDataFrame(pairs, "bin1 int, bin2 int"), halve="diagonal")
    assert {(r.i, r.j): r.value for r in d.collect()} == {(1, 2): 2, (2, 2): 1, (0, 5): 1}
    v = {(r.i, r.j): r.value for r in hc.coverage_norm(m).collect()}
    assert v[2, 2] == pytest.approx(1 / (2e-6 * 2e-6)) and v[0, 5] == 0
    e = {(r.i, r.j): r.value for r in hc.observed_over_expected(d, 6).collect()}
    assert e[2, 2] == pytest.approx(6.0) and e[1, 2] == pytest.approx(5.0)
    c = spark.createDataFrame([(1, 2, 5.0, 0), (2, 1, 7.0, 1)], "i int, j int, value double, seq int")
    assert [tuple(r) for r in hc.from_list(c, "seq").collect()] == [(1, 2, 7.0)]
    x = spark.createDataFrame([(0.0,), (5.5,), (10.0,), (99.0,)], "v double").select(hc.palette_index(F.col("v"), 0, 10, 4))
    assert [r[0] for r in x.collect()] == [0, 2, 3, 3]
    b = spark.createDataFrame([(95, True, 10), (95, False, 10)], "p int, r boolean, n int").select(hc.bin_of(F.col("p"), F.col("r"), F.col("n"), 100))
    assert [r[0] for r in b.collect()] == [1, 0]


def test_longest_ways_against_brute_force(spark):
    from functools import lru_cache

    from helixframe.operators.cycles import longest_ways

    rng = random.Random(5)
    links = {(i, rng.randrange(max(0, i - 6), i)) for i in range(1, 120)} | {(i, rng.randrange(i)) for i in range(1, 120) if rng.random() < 0.3}
    links |= {(300, 301), (301, 300), (302, 301), (302, 5), (303, 302), (304, 303), (400, 400), (401, 9), (402, 401), (403, 402)}
    par = {}
    for c, p in links:
        par.setdefault(c, set()).add(p)
    bad = {300, 301, 302, 303, 304, 400}

    @lru_cache(None)
    def level(v):
        return max((1 + level(p) for p in par.get(v, ())), default=0)

    known, rest = longest_ways(spark.createDataFrame(sorted(links), "child bigint, parent bigint"))
    assert {r.v: r.level for r in known.collect()} == {v: level(v) for v in par if v not in bad}
    assert {r.child for r in rest.collect()} == bad
    trace = []
    n = 3000
    known, rest = longest_ways(spark.range(1, n).selectExpr("id child", "id - 1 parent"), trace)
    assert known.agg({"level": "max"}).first()[0] == n - 1 and rest.isEmpty() and len(trace) < 12
