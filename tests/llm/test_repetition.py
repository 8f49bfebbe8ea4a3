import random
import unicodedata

import numpy as np

from helixframe.llm import repetition as rp


def words(t):
    out, cur = [], ""
    for c in t.lower() + " ":
        if unicodedata.category(c)[0] in "LN":
            cur += c
        elif cur:
            out.append(cur)
            cur = ""
    return out


def brute(t, run=6):
    w = words(t)
    seen, hit = set(), set()
    for i in range(len(w) - run + 1):
        g = tuple(w[i : i + run])
        if g in seen:
            hit.update(range(i, i + run))
        seen.add(g)
    return len(w), len(hit)


def texts(n=120, seed=1):
    rng = random.Random(seed)
    out = ["", None, "...", "a " * 40, "Ünïcode_words x² 日本語 " * 9, "one two three four five six " * 2, "İstanbul ΣΑΣ ﬁ " * 8, "z" * 200_000]
    for _ in range(n):
        w = [rng.choice("abcde") * rng.randrange(1, 3) for _ in range(rng.randrange(80))]
        if rng.random() < 0.5 and w:
            i = rng.randrange(len(w))
            w += w[i : i + rng.randrange(30)]
        out.append(rng.choice([" ", "_", ". ", "\n"]).join(w))
    return out


def test_measure_against_brute_force():
    ts = texts()
    w = rp.Words(ts)
    m, rep = w.rule_measures(), w.repeated()
    some = np.arange(len(ts)) % 3 == 0
    for i, t in enumerate(ts):
        assert (m["n_words"][i], rep[i]) == brute(t or ""), repr(t)[:80]
        assert w.repeated(some)[i] == (rep[i] if some[i] else 0) or i > 12
        ws = words(t or "")
        for k, name in ((1, "word_again"), (2, "pair_again"), (3, "triple_again")):
            g = [tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)]
            assert m[name][i] == ((len(g) - len(set(g))) / len(ws) if ws else 0)
    assert all((0 <= m[c]).all() and (m[c] <= 1).all() for c in rp.SHARES)
    assert all(len(v) == 0 for v in rp.Words([]).rule_measures().values())


def test_no_votes_without_words():
    w = rp.Words(["?! ... !!\n--\n--\n--. . . .", "", None, "a"])
    assert rp.votes(w.rule_measures())[:3] == ["-----"] * 3 and rp.votes(w.rule_measures())[3] != "-----"


def test_bounds_hold():
    """A text that meets the definition never gets a clean vote from the first three rules."""
    rng = random.Random(11)
    ts = ["one two three four five six seven " * 2, "a b c d e f x a b c d e f y z w v u t s r q p o n m l k j"]
    for _ in range(400):
        w = [f"w{rng.randrange(9)}" if rng.random() < 0.3 else f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(6, 60))]
        i = rng.randrange(len(w))
        ts.append(" ".join(w + w[i : i + rng.randrange(6, 14)]))
    w = rp.Words(ts)
    v, rep = rp.votes(w.rule_measures()), w.repeated()
    true = [x for x, n, r in zip(v, w.counts, rep) if r * 10 >= n * 3]
    assert len(true) > 50 and all("0" not in x[:3] and x[1:3] == "11" for x in true)


def test_other_run_lengths():
    rng = np.random.default_rng(0)
    ids, doc = rng.integers(0, 3, 500), np.sort(rng.integers(0, 6, 500))
    for run in (1, 2, 3, 5, 7, 8, 11):
        want = np.zeros(500, bool)
        for d in range(6):
            at = np.flatnonzero(doc == d)
            seen = set()
            for i in at[: max(0, len(at) - run + 1)]:
                g = tuple(ids[i : i + run])
                if g in seen:
                    want[i : i + run] = True
                seen.add(g)
        assert (rp.repeated_words(ids, doc, run) == want).all(), run


def test_fit_recovers_accuracies():
    rng = random.Random(3)
    acc = [0.95, 0.9, 0.8, 0.7, 0.6]
    counts, truth = {}, {}
    for _ in range(20_000):
        y = rng.random() < 0.2
        p = "".join("-" if rng.random() < 0.2 else str(int(y if rng.random() < a else not y)) for a in acc)
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(y)
    counts.pop("-----", None), truth.pop("-----", None)
    post, got = rp.fit(counts)
    got_post = post
    assert all(abs(g["accuracy"] - a) < 0.05 for g, a in zip(got, acc))
    right = sum((post[p] >= 0.5) == y for p, v in truth.items() for y in v) / sum(map(len, truth.values()))
    assert right > 0.93
    assert rp.fit({}) == ({}, []) and rp.fit({"-----": 3}) == ({"-----": 0.0}, [])
    post, _ = rp.fit(counts | {"-----": 10**6})  # documents no rule votes on change nothing
    assert abs(post["11111"] - got_post["11111"]) < 1e-6 and 0.15 < post["-----"] < 0.25


def corpus(n=600, seed=7):
    """Mostly varied texts, some that repeat a passage, a sentence or a paragraph."""
    rng = random.Random(seed)
    out = ["", None, "...", "a " * 40]
    for _ in range(n):
        s = [" ".join(f"w{min(rng.randrange(1, 4000), rng.randrange(1, 4000))}" for _ in range(rng.randrange(5, 14))) for _ in range(rng.randrange(3, 12))]
        kind = rng.random()
        if kind < 0.06:
            s += [s[0]] * rng.randrange(1, 6)
        elif kind < 0.12:
            s = [*s, " ".join(s), " ".join(s)]
        out.append((". " if rng.random() < 0.5 else "\n").join(s))
    return out


def test_model_names_what_is_measured(spark, monkeypatch):
    ts = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ts)], "doc_id bigint, text string, votes int").repartition(5)
    want = {i for i, t in enumerate(ts) if (b := brute(t or ""))[0] and b[1] * 10 >= b[0] * 3}
    x = rp.likely_repetitive(df).collect()
    got = {r.doc_id for r in x if r.n_words and r.n_repeated * 10 >= r.n_words * 3}
    assert got <= want and len(got & want) >= 0.9 * len(want) and len(x) < len(ts) / 2
    assert all((r.n_words, r.n_repeated) == brute(ts[r.doc_id] or "") for r in x)
    kept = {r.doc_id for r in rp.quality(df).where("p_clean > 0.5").collect()}
    assert kept == set(range(len(ts))) - {r.doc_id for r in x}
    every = {r.doc_id: (r.n_words, r.n_repeated) for r in rp.repetition(df).collect()}
    assert every == {i: brute(t or "") for i, t in enumerate(ts)}
    monkeypatch.setattr(rp, "_suspect", lambda p: False)  # no text is kept: all are read again
    assert sorted(map(tuple, rp.likely_repetitive(df).collect())) == sorted(map(tuple, x))
    monkeypatch.undo()
    rules = {r.rule: r for r in rp.rule_report(df).collect()}
    assert rules["triples"].accuracy > 0.9 and set(rules) == set(rp.RULES)
    for f in (rp.likely_repetitive, rp.repetition, rp.quality, rp.rule_report):
        assert f(df.limit(0)).count() == 0
    monkeypatch.setattr(rp, "fit", lambda c: ({}, []))  # without the model nothing is named
    assert rp.likely_repetitive(df).count() == 0
