"""Repetition inside a single document: cheap rules vote, their votes are weighed together, and what is
likely repetitive is measured exactly.

Every rule votes repetitive (1), clean (0) or abstains (-). How far each rule can be trusted is not
set but estimated: expectation-maximisation fits, for both classes, the chance of each vote of each
rule to the counts of vote patterns over all documents. The posterior of a document's pattern replaces
a filter that all rules must pass: it decides which documents are kept as clean, and which are measured.

No rule is the definition (words in runs of six that also start earlier). The rules on words, pairs and
triples do bound it, though: of the words of a repeated run, 5 of 6 begin a pair and 4 of 6 a triple
that occurred before, so a text with 3/10 of its words repeated has 1/4 of them in repeated pairs and
1/5 in repeated triples. Such a text never gets a clean vote from these three.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from helixframe.runtime import materialize

#: Letters and numbers (Unicode categories L and N).
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?。！？\n]+")
#: Words of a run that counts as repeated.
RUN = 6
#: Characters that are worked on together.
CHUNK = 3_000_000

#: Rule: (measure, repetitive from, clean below, measure of size, least size for a vote).
RULES = {
    "words": ("word_again", 0.5, 0.3, "n_words", 1),
    "pairs": ("pair_again", 0.25, 0.25, "n_words", 1),
    "triples": ("triple_again", 0.2, 0.2, "n_words", 1),
    "sentences": ("sentence_again", 0.25, 1e-9, "n_sentences", 5),
    "paragraphs": ("paragraph_again", 0.2, 1e-9, "n_paragraphs", 3),
}
SIZES = ["n_words", "n_sentences", "n_paragraphs"]
SHARES = [r[0] for r in RULES.values()]
#: Documents from this posterior on count as repetitive.
POSTERIOR = 0.5


def _join_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ids of pairs (a, b): equal pairs, and only those, get equal ids."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1] if len(a) else a


def repeated_words(ids: np.ndarray, doc: np.ndarray, run: int = RUN) -> np.ndarray:
    """True for words inside a run of ``run`` words that also starts at an earlier word of the same document.

    ``ids`` are word ids of documents laid end to end, ``doc`` their ascending document numbers. Runs
    get exact ids by joining ids of shorter runs, so no hash can clash.
    """
    n = len(ids) - run + 1
    out = np.zeros(len(ids), dtype=bool)
    if n <= 0:
        return out
    have, cur, size = {1: ids}, ids, 1
    while size * 2 <= run:
        cur = _join_ids(cur[: len(cur) - size], cur[size:])
        size *= 2
        have[size] = cur
    rest = run - size
    for s in sorted(have, reverse=True):
        while rest >= s:
            m = len(ids) - size - s + 1
            cur = _join_ids(cur[:m], have[s][size : size + m])
            size, rest = size + s, rest - s
    inside = np.flatnonzero(doc[:n] == doc[run - 1 :])
    key = doc[inside] * (int(cur.max()) + 1) + cur[inside]
    again = np.ones(len(inside), dtype=bool)
    again[np.unique(key, return_index=True)[1]] = False
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, inside[again], 1)
    np.add.at(edge, inside[again] + run, -1)
    return np.cumsum(edge[:-1]) > 0


def _seen_share(parts: list[str]) -> tuple[int, float]:
    """Number of non-blank parts, and the share of their characters that lies in parts seen before."""
    seen, total, again, n = set(), 0, 0, 0
    for p in parts:
        p = p.strip()
        if p:
            n += 1
            total += len(p)
            if p in seen:
                again += len(p)
            seen.add(p)
    return n, again / total if total else 0.0


class Words:
    """The words of some texts as ids, laid end to end."""

    def __init__(self, texts: list[str | None]):
        self.texts = texts
        self.low = [(t or "").lower() for t in texts]
        words = [_WORD.findall(t) for t in self.low]
        self.n = len(texts)
        self.counts = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.empty(int(self.counts.sum()), dtype=object)
        flat[:] = [x for w in words for x in w]
        self.ids = pd.factorize(flat)[0].astype(np.int64)
        self.doc = np.repeat(np.arange(self.n), self.counts)

    def rule_measures(self) -> dict[str, np.ndarray]:
        """Sizes, and the measures the rules vote on."""
        share = lambda a: np.divide(a, self.counts, out=np.zeros(self.n), where=self.counts > 0)
        out = {"n_words": self.counts}
        base = int(self.ids.max()) + 1 if len(self.ids) else 1
        key, doc = self.doc * base + self.ids, self.doc
        for width, name in ((1, "word_again"), (2, "pair_again"), (3, "triple_again")):
            if width > 1:  # ids of shorter runs hold their document; a run ends with a word of the same one
                m = max(0, len(self.ids) - width + 1)
                inside = self.doc[:m] == self.doc[width - 1 :] if m else np.zeros(0, dtype=bool)
                key, doc = (run[:m] * base + self.ids[width - 1 :])[inside] if m else run[:0], self.doc[:m][inside]
            if width < 3:
                _, first, back = np.unique(key, return_index=True, return_inverse=True)
                run = np.zeros(len(self.ids), dtype=np.int64)
                run[np.flatnonzero(inside) if width > 1 else slice(None)] = back
            else:
                first = np.unique(key, return_index=True)[1]
            out[name] = share(np.bincount(doc, minlength=self.n) - np.bincount(doc[first], minlength=self.n))
        for what, parts in (("sentence", (_SENTENCE.split(t) for t in self.low)), ("paragraph", (t.split("\n") for t in self.low))):
            seen = [_seen_share(p) for p in parts]
            out[f"n_{what}s"] = np.array([s[0] for s in seen], dtype=np.int64)
            out[f"{what}_again"] = np.array([s[1] for s in seen], dtype=float)
        return out

    def repeated(self, of: np.ndarray | None = None) -> np.ndarray:
        """Words of each text that lie in repeated runs; with ``of`` (one Boolean a text) 0 for the others."""
        if of is None:
            return np.bincount(self.doc[repeated_words(self.ids, self.doc)], minlength=self.n)
        take = of[self.doc]
        ids, doc = self.ids[take], self.doc[take]
        return np.bincount(doc[repeated_words(ids, doc)], minlength=self.n)


def votes(m: dict[str, np.ndarray]) -> list[str]:
    """The vote pattern of each text, one letter a rule. On a text without words no rule votes."""
    cols = []
    for col, yes, no, of, least in RULES.values():
        big = (m[of] >= least) & (m["n_words"] > 0)
        cols.append(np.where(big & (m[col] >= yes), "1", np.where(big & (m[col] < no), "0", "-")))
    return ["".join(v) for v in zip(*cols, strict=True)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Words]]:
    """Keys and words of texts that are worked on together; a long text is worked on alone."""
    for b in batches:
        texts = b.column("t").to_pylist()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK):
                size += len(texts[end] or "")
                end += 1
            yield b.column("k").slice(at, end - at), Words(texts[at:end])
            at = end


def _batch(k: pa.Array, cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([k, *[pa.array(v) for v in cols.values()]], names=["k", *cols])


def _keyed(df: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    x = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return x, f"k {x.schema['k'].dataType.simpleString()}"


def rule_votes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k, votes`` of each whole text. No shuffle; one row per input row."""

    def run(batches):
        for k, w in _chunks(batches):
            yield _batch(k, {"votes": pa.array(votes(w.rule_measures()), pa.string())})

    x, k = _keyed(df, key, text)
    return x.mapInArrow(run, f"{k}, votes string")


def measures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every measure of each whole text, the exact one too, and its votes: ``k, n_words, ..., n_repeated, votes``."""

    def run(batches):
        for k, w in _chunks(batches):
            m = w.rule_measures()
            yield _batch(k, {**{c: m[c] for c in SIZES + SHARES}, "n_repeated": w.repeated().astype(np.int64), "votes": pa.array(votes(m), pa.string())})

    x, k = _keyed(df, key, text)
    return x.mapInArrow(run, ", ".join([k, *(f"{c} bigint" for c in SIZES), *(f"{c} double" for c in SHARES), "n_repeated bigint, votes string"]))


def fit(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], list[dict[str, float]]]:
    """Posterior of each vote pattern, and the estimated accuracy of each rule where it votes.

    Latent class model with two classes and three outcomes per rule; it starts from the majority vote,
    so the classes cannot be swapped. Counts are smoothed by one half. A pattern without any vote says
    nothing: it stays out of the fit and gets the share of repetitive documents as its posterior.
    """
    pats = sorted(p for p in patterns if set(p) != {"-"})
    silent = {p: 0.0 for p in patterns if set(p) == {"-"}}
    if not pats:
        return silent, []
    n = np.array([patterns[p] for p in pats], dtype=float)
    r = len(pats[0])
    vote = np.array([["01-".index(c) for c in p] for p in pats])
    ones, zeros = (vote == 1).sum(1), (vote == 0).sum(1)
    q = (ones + 0.5) / (ones + zeros + 1.0)
    for _ in range(rounds):
        w = np.stack([n * (1 - q), n * q])
        prior = (w.sum(1) + 0.5) / (n.sum() + 1.0)
        theta = np.empty((2, r, 3))
        for j in range(r):
            for v in range(3):
                theta[:, j, v] = w[:, vote[:, j] == v].sum(1) + 0.5
        theta /= theta.sum(2, keepdims=True)
        score = np.log(prior)[:, None] + sum(np.log(theta[:, j, :][:, vote[:, j]]) for j in range(r))
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))
        done = np.max(np.abs(new - q)) < 1e-9
        q = new
        if done:
            break
    acc = []
    for j in range(r):
        votes = {v: (n * (vote[:, j] == v)) for v in (0, 1)}
        right = (votes[1] * q).sum() + (votes[0] * (1 - q)).sum()
        acc.append({"coverage": float((votes[0] + votes[1]).sum() / n.sum()), "accuracy": float(right / max(1e-12, (votes[0] + votes[1]).sum()))})
    share = float((n * q).sum() / n.sum())
    return {p: float(x) for p, x in zip(pats, q, strict=True)} | {p: share for p in silent}, acc


def _fitted(patterned: DataFrame) -> tuple[dict[str, float], list[dict[str, float]]]:
    """Fit to the counts of vote patterns (at most 3 ** rules rows reach the driver)."""
    return fit({r[0]: r[1] for r in patterned.groupBy("votes").agg(F.count(F.lit(1))).collect()})


def posterior(votes_: Column, post: dict[str, float]) -> Column:
    """The posterior of each pattern as a column; NULL for patterns that were not fitted."""
    return F.create_map(*[v for p, x in post.items() for v in (F.lit(p), F.lit(x))])[votes_] if post else F.lit(None).cast("double")


def repetition(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The exact share and all measures, the votes and the posterior ``p_repetitive`` of every document.

    NULL and empty texts have no words, share 0 and the posterior of their pattern; repeated keys stay
    rows of their own. An empty table gives no row.
    """
    m = materialize(measures(df, key, text), "repetition")
    post, _ = _fitted(m)
    return m.withColumn("repeated_share", F.coalesce(F.try_divide("n_repeated", "n_words"), F.lit(0.0))).withColumn("p_repetitive", posterior(F.col("votes"), post)).withColumnRenamed("k", key)


def _suspect(pattern: str) -> bool:
    """Whether a rule other than that on single words votes repetitive."""
    return "1" in pattern[1:]


def likely_repetitive(df: DataFrame, key: str = "doc_id", text: str = "text", *, at_least: float = POSTERIOR) -> DataFrame:
    """The documents whose posterior is at least ``at_least``, measured: ``key, n_words, n_repeated, p_repetitive``.

    All documents vote and enter the fit, and only those with such a posterior pay for the exact measure.
    Rules that say clean can outweigh the others, so a document is measured or left out by the model
    alone; :func:`repetition` measures all. Texts that some rule finds repetitive are written beside
    their votes; should the model name a pattern without any such vote, all texts are read again.
    """
    x, k = _keyed(df, key, text)

    def vote(batches):
        for key_, w in _chunks(batches):
            v = votes(w.rule_measures())
            yield _batch(key_, {"votes": pa.array(v, pa.string()), "t": pa.array([t if _suspect(p) else None for p, t in zip(v, w.texts, strict=True)], pa.string())})

    voted = materialize(x.mapInArrow(vote, f"{k}, votes string, t string"), "votes")
    post, _ = _fitted(voted)
    named = {p: q for p, q in post.items() if q >= at_least}

    def measure(batches):
        for both, w in _chunks(batches):
            yield _batch(both.field("k"), {"n_words": w.counts, "n_repeated": w.repeated().astype(np.int64), "votes": both.field("votes")})

    def measure_again(batches):
        for key_, w in _chunks(batches):
            v = votes(w.rule_measures())
            take = np.array([p in named for p in v], dtype=bool)
            at = np.flatnonzero(take)
            yield _batch(key_.take(pa.array(at)), {"n_words": w.counts[at], "n_repeated": w.repeated(take)[at].astype(np.int64), "votes": pa.array([v[i] for i in at], pa.string())})

    if all(map(_suspect, named)):
        few = voted.where(F.col("votes").isin(list(named) or [""]))
        done = few.select(F.struct("k", "votes").alias("k"), "t").mapInArrow(measure, f"{k}, n_words bigint, n_repeated bigint, votes string")
    else:
        done = x.mapInArrow(measure_again, f"{k}, n_words bigint, n_repeated bigint, votes string")
    return done.withColumn("p_repetitive", posterior(F.col("votes"), post)).drop("votes").withColumnRenamed("k", key)


def quality(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, votes, p_clean``: the posterior probability that a document does not repeat itself."""
    v = materialize(rule_votes(df, key, text), "votes")
    post, _ = _fitted(v)
    return v.select(F.col("k").alias(key), "votes", (1 - posterior(F.col("votes"), post)).alias("p_clean"))


def rule_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``rule, coverage, accuracy``: how often each rule votes, and how often its vote is right by the model."""
    _, acc = _fitted(rule_votes(df, key, text))
    return df.sparkSession.createDataFrame([(n, a["coverage"], a["accuracy"]) for n, a in zip(RULES, acc)], "rule string, coverage double, accuracy double")
