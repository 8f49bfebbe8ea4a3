import math
import random

import numpy as np
import pytest

from helixframe import cli
from helixframe.motif import align as al, pwm, scan
from helixframe.sources import formats as fm

#: Matrix of the benchmark's shape: ten rows.
M = np.array([[0.3, 0.3, 0.3, 0.1], [0.0, 0.5, 0.0, 0.5], [0.1, 0.2, 0.5, 0.2], [0.1, 0.1, 0.1, 0.7], [0.0, 0.0, 0.0, 1.0], [0.25, 0.25, 0.25, 0.25], [0.1, 0.1, 0.3, 0.5], [0.25, 0.25, 0.0, 0.5], [0.1, 0.1, 0.7, 0.1], [0.0, 0.0, 0.0, 1.0]])


def dna(n, seed=0, letters="ACGT"):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def test_scores_and_hits():
    s = dna(3000, 1)
    sc = pwm.scores(M, s)
    assert len(sc) == 2991 and sc[7] == pytest.approx(pwm.score(M, s[7:17]))
    want = sum(math.log((M[j]["ACGT".index(c)] or 1e-4) / 0.25) for j, c in enumerate(s[:10]))
    assert sc[0] == pytest.approx(want)
    th = 0.6 * pwm.optimal_score(M)
    at, v = pwm.find_hits(M, s, th)
    assert at.tolist() == [i for i in range(len(sc)) if sc[i] >= th] and len(at)
    assert pwm.max_match(M, s) == sc.max() and pwm.max_match(M, "ACG") == -math.inf
    n = dna(800, 2, "ACGTNRY")
    amb, _ = pwm.find_hits(M, n, -50)
    assert amb.tolist() == [i for i in range(791) if set(n[i : i + 10]) <= set("ACGT")]
    with pytest.raises(ValueError):
        pwm.score(M, "ACGTXACGTA")
    assert pwm.score(M[:1], "N") == 0 and pwm.score(M[:1], "R") == pytest.approx(math.log(0.6 / 0.5))


def test_reverse_complement_mirrors_scores():
    s = dna(500, 3)
    rc = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert np.allclose(pwm.scores(M, s), pwm.scores(pwm.reverse_complement(M), rc)[::-1], atol=1e-5)


def test_cdf():
    d = pwm.score_cdf(M)
    small = np.array([[0.7, 0.1, 0.1, 0.1], [0.2, 0.5, 0.2, 0.1], [0.1, 0.1, 0.2, 0.6], [0.4, 0.3, 0.2, 0.1]])
    for p in (0.3, 0.05, 0.01):
        assert round(10 * pwm.p_value_to_score(p, small)) == pytest.approx(round(10 * pwm.p_value_to_score_exact(p, small)), abs=12)
    v, p = d
    assert p[-1] == pytest.approx(1) and (np.diff(v) > 0).all() and (np.diff(p) >= 0).all()
    x = pwm.cdf_inverse(d, 0.9)
    assert pwm.cdf(d, x) == pytest.approx(0.9) and pwm.cdf(d, v[0] - 1) == 0 and pwm.cdf(d, v[-1] + 9) == p[-1]
    assert pwm.cdf_inverse(pwm.truncate_cdf(d, 0.999), 1 - 1e-4) == pytest.approx(pwm.cdf_inverse(d, 1 - 1e-4))
    with pytest.raises(ValueError):
        pwm.cdf_inverse(d, 1.5)
    words = [dna(10, i) for i in range(20_000)]
    q = pwm.cdf_inverse(d, 0.95)
    clipped = np.where(M == 0, 1e-3, M)
    assert abs(np.mean([pwm.score(clipped, w) > q for w in words]) - 0.05) < 0.01


def test_matrix_functions():
    assert pwm.consensus(np.array([[0.6, 0.1, 0.2, 0.1], [0.4, 0.4, 0.1, 0.1], [0.3, 0.3, 0.2, 0.2], [0.0, 0.45, 0.0, 0.55]])) == "AMNY"
    assert pwm.gc_content(np.array([[0.0, 0.5, 0.5, 0.0], [1.0, 0, 0, 0]])) == 0.5
    assert pwm.sub_matrix(M, 2, 3).tolist() == M[2:5].tolist()
    assert pwm.optimal_suffix_scores(M)[0] == pytest.approx(pwm.optimal_score(M) - math.log(0.3 / 0.25)) and pwm.optimal_suffix_scores(M)[-1] == 0
    assert len(pwm.trim(np.vstack([[[0.25] * 4], M, [[0.25] * 4]]), 0.01)) == len(M)
    assert pwm.background_probability("ACGT", (0.1, 0.2, 0.3, 0.4)) == pytest.approx(0.0024)


def test_alignment():
    a = al.aligner()
    b = M[2:8]
    assert a(M, M) == (0.0, True, 0)
    d, same, at = a(M, b)
    assert same and at == 2
    assert a(M, pwm.reverse_complement(b))[1:] == (False, 2)
    assert a(b, M)[1:] == (True, -2)
    pen = al.gap_penalty("exp", 0.05)
    assert d == pytest.approx(pen(4, 6))
    x = al.column_distances(M, M)
    assert np.allclose(np.diag(x), 0) and x[1, 4] == pytest.approx(0.5 * (sum(p * math.log2(p / m) for p, m in ((0.5, 0.25), (0.5, 0.75))) + math.log2(1 / 0.75)))
    assert al.aligner("linear", 0.1, "max")(M, b)[2] == 2


def test_merging():
    u = np.full((2, 4), 0.25)
    m, w = al.merge_weighted(M[:3], [1, 1, 1], u, [3, 3], 2)
    assert m.shape == (4, 4) and w == [1, 1, 4, 3] and m[2].tolist() == pytest.approx(((M[2] + 3 * 0.25) / 4).tolist())
    m, w = al.merge_weighted(M[:3], [1, 1, 1], u, [3, 3], -1)
    assert w == [3, 4, 1, 1]
    assert al.merge(M[:2], u, 0)[0].tolist() == pytest.approx(((M[0] + 0.25) / 2).tolist())
    assert al.dilute(M[:2], [1, 2])[0].tolist() == pytest.approx(((M[0] + 0.25) / 2).tolist())
    ms = [pwm.Motif("a", M), pwm.Motif("b", pwm.reverse_complement(M)), pwm.Motif("c", np.roll(M, 1, axis=1))]
    out = al.iterative_merge(al.aligner(), 0.05, ms)
    assert [x[0] for x in out] == [["a", "b"], ["c"]] and np.allclose(out[0][1], M) and out[0][2] == [2] * 10
    tree = al.build_tree(al.aligner(), ms)
    assert [[m.name for m in t.leaves()] for t in al.cut_tree(tree, 0.05)] == [["a", "b"], ["c"]]
    assert len(al.cut_tree_by(10, 1, lambda c: len(c) > 1, tree)) >= 1
    assert np.allclose(al.merge_tree(al.aligner(), al.cut_tree(tree, 0.05)[0])[0], M)
    assert [m.name for m in cli.merge_motifs(ms, al.aligner(), threshold=0.05)] == ["a+b", "c"] == [m.name for m in cli.merge_motifs(ms, al.aligner(), mode="tree", threshold=0.05)]


def test_spark_scan(spark):
    cm = scan.cutoff_motif(pwm.Motif("m", M), 1e-3)
    rows = [("c1", 100, dna(400, 5)), ("c2", 0, dna(300, 6, "ACGTN")), ("c3", 0, "AC"), ("c4", 0, None), ("c5", 0, "xyz" * 9), ("c6", 5, "")]
    got = sorted(map(tuple, scan.scan_regions(spark.createDataFrame(rows, "chrom string, chrom_start bigint, seq string"), [cm]).collect()))
    want = []
    for c, s, q in rows[:2]:
        for st, m in ((True, M), (False, pwm.reverse_complement(M))):
            at, sc = pwm.find_hits(m, q, cm.cutoff)
            want += [(c, s + i, s + i + 10, "m", scan.affinity(1 - pwm.cdf(cm.dist, x)), st) for i, x in zip(at.tolist(), sc)]
    assert got == sorted(want) and got
    w = scan.score_windows(spark.createDataFrame(rows, "chrom string, chrom_start bigint, seq string"), "chrom", "seq", pwm.Motif("m", M)).where("chrom = 'c2'").orderBy("start").collect()
    assert [r.score for r in w] == pytest.approx(pwm.scores(M, rows[1][2]).tolist()) and w[-1].start == 290
    assert scan.affinity(1e-5) == 500 and scan.affinity(0) == 1000


def test_files_and_distances(spark, tmp_path):
    ms = [pwm.Motif("lexA", M, 14), pwm.Motif("7 V_ELK", pwm.reverse_complement(M), None)]
    text = fm.to_meme(ms)
    back = fm.parse_meme(text.replace("0.25 0.25", "0.25\t0.25"))
    assert [m.name for m in back] == ["lexA", "7 V_ELK"] and np.allclose(back[0].mat, M) and [m.n_sites for m in back] == [14, 1]
    unfinished = text.replace("\n\nMOTIF 7", "\nMOTIF 7").replace("nsites= 14", "nsites= 14 E= 3.2e-035")
    assert len(fm.parse_meme(unfinished)) == 2
    p = tmp_path / "m.meme"
    p.write_text(text)
    t = fm.read_meme(spark, str(p))
    assert [m.name for m in fm.collect_motifs(t)] == ["7 V_ELK", "lexA"]
    fa = fm.parse_motif_fasta(fm.to_motif_fasta(ms))
    assert fa[1].name == "7 V_ELK" and np.allclose(fa[1].mat, ms[1].mat)
    d = scan.pairwise_distances(fm.motif_table(spark, ms)).collect()
    assert len(d) == 1 and d[0].distance == pytest.approx(0) and not d[0].same_strand
    assert scan.pairwise_distances(t, t).count() == 4
    out = tmp_path / "o.meme"
    assert cli.main(["merge-motifs", "merge", str(p), "-o", str(out), "--threshold", "0.05"]) == 0
    assert [m.name for m in cli.load_motifs(str(out))] == ["lexA+7 V_ELK"]
