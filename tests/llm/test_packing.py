import itertools
import random

import pytest

from helixframe.llm import packing, tokens
from helixframe.llm.queries import VOCABULARY


def test_window_is_nearest():
    rng = random.Random(1)
    for _ in range(150):
        counts = {rng.randrange(1, 15): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        room = rng.randrange(0, 40)
        use = packing.fill_window(sorted(counts, reverse=True), counts, room)
        items = [x for x, k in counts.items() for _ in range(k)]
        best = max(s for r in range(len(items) + 1) for s in (sum(c) for c in itertools.combinations(items, r)) if s <= room)
        assert sum(x * k for x, k in use.items()) == best and all(k <= counts[x] for x, k in use.items())


def fewest(hist, cap):
    """Lower bound on the boxes of any packing: items above half a box cannot share one (Martello and Toth's L2)."""
    best = 0
    for k in range(cap // 2 + 1):
        alone = sum(n for x, n in hist.items() if x > cap - k)
        half = {x: n for x, n in hist.items() if cap // 2 < x <= cap - k}
        small = sum(x * n for x, n in hist.items() if k <= x <= cap // 2)
        free = sum((cap - x) * n for x, n in half.items())
        best = max(best, alone + sum(half.values()) + max(0, -(-(small - free) // cap)))
    return best


def test_recipes_use_everything_once():
    rng = random.Random(2)
    hist = {rng.randrange(1, 513): rng.randrange(1, 2000) for _ in range(200)}
    left = dict(hist)
    boxes = 0
    for times, use in packing.recipes(hist, 512):
        assert sum(x * k for x, k in use.items()) <= 512 and times > 0
        boxes += times
        for x, k in use.items():
            left[x] -= times * k
    assert not any(left.values())
    assert boxes <= 1.02 * fewest(hist, 512)
    assert packing.recipes({}, 5) == [] and packing.recipes({5: 3}, 5) == [(3, {5: 1})]


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_pack(spark, monkeypatch, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    monkeypatch.setattr(packing, "BUCKET_ROWS", 60)
    rng = random.Random(3)
    sizes = [7] * 300 + [rng.choice([0, None, 1, 50, 64, 65, 128, 1000, rng.randrange(200)]) for _ in range(300)]
    df = spark.createDataFrame([(i % 550, s, "x") for i, s in enumerate(sizes)], "doc_id bigint, n_tokens bigint, box_name string").repartition(5)
    boxes = [("a", 64), ("b", 1), ("c", 5000)]
    rows = packing.pack(df, boxes).collect()
    for name, cap in boxes:
        mine = [r for r in rows if r.box_name == name]
        fill, per = {}, {}
        for r in mine:
            per.setdefault(r.doc_id, []).append((r.piece, r.piece_start, r.piece_tokens))
            assert (r.box_no is None) == (r.piece_tokens == 0)
            if r.box_no is not None:
                fill[r.box_no] = fill.get(r.box_no, 0) + r.piece_tokens
        assert all(v <= cap for v in fill.values()) and sorted(fill) == list(range(len(fill)))
        want = {}
        for i, s in enumerate(sizes):
            s = s or 0
            cut = [(0, 0, 0)] if not s else [(p, p * cap, min(cap, s - p * cap)) for p in range(-(-s // cap))]
            want.setdefault(i % 550, []).extend(cut)
        assert {k: sorted(v) for k, v in per.items()} == {k: sorted(v) for k, v in want.items()}
        assert len(fill) <= 1.05 * sum(s or 0 for s in sizes) / cap + 1
    s = {r.box_name: r for r in packing.slack(packing.pack(df, boxes), boxes).collect()}
    assert s["b"].unused_share == 0 and s["a"].n_boxes >= s["a"].least_boxes
    assert packing.pack(df.limit(0), boxes).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, [("a", 0)])


def test_shards_side_by_side(spark, monkeypatch):
    """A dense histogram dealt to shards: everything is placed once, and hardly any room is lost."""
    monkeypatch.setattr(packing, "SHARD_LENGTHS", 512)
    rng = random.Random(5)
    hist = {x: rng.randrange(1, 400) for x in range(1, 2049) if rng.random() < 0.9}
    df = spark.createDataFrame([("b", x, n, 2048) for x, n in hist.items()], "box_name string, len bigint, n bigint, capacity bigint")
    plan = packing.plan_boxes(df, [("b", 2048)]).collect()
    fill, spans = {}, {}
    for r in plan:
        spans.setdefault(r.len, []).append((r.lo, r.hi))
        for i in range(r.lo, r.hi):
            box = r.base + (i - r.lo) // r.per_box
            fill[box] = fill.get(box, 0) + r.len
    for x, v in spans.items():
        v.sort()
        assert v[0][0] == 0 and v[-1][1] == hist[x] and all(a[1] == b[0] for a, b in zip(v, v[1:]))
    assert set(spans) == set(hist) and max(fill.values()) <= 2048 and sorted(fill) == list(range(len(fill)))
    assert len(fill) <= 1.02 * sum(x * n for x, n in hist.items()) / 2048


def test_token_counts(spark):
    texts = ["", None, "hello world", "<|endoftext|>", " " * 30_000, "a" * 50_000, "é日本 \U0001f600"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in tokens.with_token_counts(df, ["doc_id"], VOCABULARY).collect()}
    enc = tokens.encoding(VOCABULARY)
    assert got == {i: len(enc.encode(t or "", disallowed_special=())) for i, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary(texts[6])) == texts[6] and tokens.with_token_counts(df.limit(0), ["doc_id"], VOCABULARY).count() == 0
