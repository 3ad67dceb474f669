"""Hard negatives, positive-unlabelled quality and the prefix trie against plain versions and odd tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import hard_negatives as hn, prefix_trie as pt, pu_quality as pu

VECTORS = "vec_id long, embedding array<double>, label int, norm double, anchor string"  # the last two clash with inner names
TURNS = "conv_id long, turn int, role string, text string, key string, block long"


def plain_negatives(rows, anchors, positives=5, negatives=3):
    """By the contract, with whole numbers."""
    rows = list({(i, y, tuple(int(np.floor(256 * x)) for x in v)) for i, v, y, *_ in rows
                 if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for a, y, v in rows:
        if not anchors(a):
            continue
        score = [(sum(p * q for p, q in zip(v, w, strict=False)), i, z) for i, z, w in rows if i != a]
        score.sort(key=lambda s: (-s[0], s[1]))
        for ps, p, _ in [s for s in score if s[2] == y][:positives]:
            fit = [s for s in score if s[2] != y and 50 * ps <= 100 * s[0] <= 95 * ps][:negatives]
            out += [(a, p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(fit)]
    return sorted(out)


def mined(df, **more):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in cols) for r in hn.hard_negatives(df, F.col("vec_id") % 5 == 0, **more).collect())


def clustered(n, dim, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim)) * 2
    return [(i, (centres[0] if i < copies else centres[rng.integers(8)] + 0.3 * rng.normal(size=dim)).tolist(), int(rng.integers(3)), 1.0, "x") for i in range(n)]


@pytest.mark.parametrize(("references", "block", "copies"), [(0, 7, 0), (3, 16, 0), (48, 1000, 40)])
def test_hard_negatives_equal_brute_force(spark, references, block, copies):
    rows = clustered(120, 6, block, copies)
    got = mined(spark.createDataFrame(rows, VECTORS), references=references, block=block, anchor_block=9)
    assert got == plain_negatives(rows, lambda i: i % 5 == 0) and got


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(30, 4, 5) + [(30, None, 1, 0.0, None), (35, [1.0, None, 2.0, 3.0], 1, 0.0, ""), (40, [nan, 0.0, 0.0, 0.0], 1, None, ""), (45, [inf, 0.0, 0.0, 0.0], 1, None, ""),
                                  (50, [1.0, 1.0, 1.0, 1.0], None, None, None), (None, [1.0, 1.0, 1.0, 1.0], 1, None, None), (55, [0.0] * 4, 1, None, None), (60, [2.0, 1.0], 1, None, None),
                                  (65, [], 2, None, None), (70, [0.0] * 4, 2, None, None)]
    rows += rows[:3] + [(5, [9.0, 9.0, 9.0, 9.0], 2, None, None)]  # repeated rows, one id twice
    df = spark.createDataFrame(rows, VECTORS)
    assert mined(df) == plain_negatives(rows, lambda i: i % 5 == 0)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id % 5 <> 0")) == [] and mined(df.where("vec_id IS NULL")) == []


def test_angular_windows_hold_every_score_and_skip_most():
    rng = np.random.default_rng(4)
    dim, n = 32, 2000
    basis_of = rng.normal(size=(6, dim))
    v = np.floor(256 * (rng.normal(size=(n, 6)) @ basis_of + 0.05 * rng.normal(size=(n, dim))))
    norm = np.sqrt((v**2).sum(1))
    basis = hn.directions(v[:300], 8)
    import pandas as pd
    pdf = pd.DataFrame({"vec_id": range(n), "label": rng.integers(0, 4, n), "norm": norm, "v": [x.tobytes() for x in v], "angles": [x.tobytes() for x in hn.angles(v, norm, basis)]})
    rows, anchors = hn.Rows(pdf, dim, len(basis)), hn.Rows(pdf[:50], dim, len(basis))
    lo, hi = rows.window(anchors, np.arange(n), slice(None))
    exact = v[:50] @ v.T
    assert (lo <= exact).all() and (exact <= hi).all()
    best = hn.best_positives(rows, anchors, 5)
    positives = [[g[2] for g in best if g[0] == a] for a in range(50)]
    found = hn.best_negatives(rows, anchors, positives, 3)
    assert all(len(x) == 5 for x in positives)
    assert np.mean([g[3] for g in best]) < 0.1 * n and np.mean([g[4] for g in found]) < 0.1 * n  # rows that got a whole score


def test_exact_scores_beyond_doubles(spark):
    big = 2.0**22
    rows = [(0, [big, big + 0.5], 0, None, None), (1, [big, big], 0, None, None), (2, [big / 2, big / 3 + 0.25], 1, None, None), (3, [big * 0.9, big * 0.9 + 1.0], 1, None, None)]
    assert mined(spark.createDataFrame(rows, VECTORS)) == plain_negatives(rows, lambda i: i % 5 == 0)


def plain_trie(convs):
    members, kids = defaultdict(list), defaultdict(set)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].add(p)

    def below(p):
        saved, leaves = (len(members[p]) - 1) * len(p[-1][1]) if p else 0, 0 if kids[p] else 1
        for k in kids[p]:
            s, n = below(k)
            saved, leaves = saved + s, leaves + n
        return saved, leaves

    out = []
    for p, m in members.items():
        saved, leaves = below(p)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted(((r[0], r[1], r[2] or "", r[3] or "") for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role, text))
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + t[h:]
    return out


def trie(df, block_turns):
    return sorted((tuple(r) for r in pt.prefix_trie(pt.rebuilt(pt.turns_of(df)), block_turns).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_prefix_trie_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(450), 150):
        hot = rng.random() < 0.4  # copies of one conversation
        n = 7 if hot else rng.choice([0, 1, 2, 5, 8, 12])
        rows += [(c, i, "a" if hot else rng.choice("ab"), "hot" if hot else rng.choice(["", "x", "yÿ😀"]), "k", 1) for i in range(n)]
    df = spark.createDataFrame(rows, TURNS)
    want = plain_trie(plain_rebuilt(rows))
    assert trie(df, 11) == trie(df, 100) == trie(df, pt.BLOCK_TURNS) == want


def test_prefix_trie_of_odd_rows(spark):
    rows = [(1, 1, "user", "b", None, None), (1, None, None, None, None, None), (None, 1, "user", "x", "k", 1), (2, 1, "user", "b", "k", 2), (2, 1, "user", "b", "k", 2),
            (100, 0, "user", "z" * 300_000, None, 1), (101, 0, "user", "z" * 300_000, None, 1), (-3, 0, "", "", "", 0)]
    rows += [(205, i, "a", "t", None, None) for i in range(700)] + [(206, i, "a", "t", None, None) for i in range(650)]  # long conversations
    df = spark.createDataFrame(rows, TURNS)
    want = [r for r in rows if r[0] != -3]
    got = trie(df.where("conv_id <> -3 OR conv_id IS NULL"), 100)
    import sys
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(5000)
    try:
        assert got == plain_trie(plain_rebuilt(want))
    finally:
        sys.setrecursionlimit(limit)
    assert len(trie(df, 100)) == len(plain_trie_nodes(plain_rebuilt(rows), -3))
    assert trie(df.limit(0), 100) == [] and trie(df.where("conv_id IS NULL"), 100) == []


def plain_trie_nodes(convs, odd):
    """Prefixes; a negative id's head comes from c - c % 100 with SQL's remainder, conversation 0 here."""
    convs[odd] = []  # its only turn falls under its h = 1 to 5 head turns, or stays
    h = zlib.crc32(str(odd).encode()) % 6
    convs[odd] = [("", "")][h:]
    return {tuple(t[:d]) for t in convs.values() for d in range(len(t) + 1)}


def test_extents_by_binary_search():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, 50)
    table = pt.range_min(x)
    at, depth = np.repeat(np.arange(50), 5), np.tile(np.arange(5), 50)
    right, left = pt.right_end(table, at, depth), pt.left_end(table, at, depth)
    for i, d, r, s in zip(at, depth, right, left, strict=True):
        assert r == next((j - 1 for j in range(i + 1, 50) if x[j] < d), 49)
        assert s == next((j for j in range(i, 0, -1) if x[j] < d), 0)
    lo, hi = np.sort(rng.integers(0, 50, (2, 80)), axis=0)
    assert pt.least(table, lo, hi).tolist() == [x[a:b + 1].min() for a, b in zip(lo, hi, strict=True)]


def test_shapes_of_texts():
    got = pu.features(["", "aB", "x x\n!", "é", "a" * 100_000]).astype(float)
    assert got.shape == (5, pu.WIDTH) and not got[0].any()
    assert got[1, 0 * pu.N_CLASSES + 1] == 1 and got[3, 0] == 1 and got[4, 0] == 1
    one = np.concatenate([pu.features([t]) for t in ("", "aB", "x x\n!", "é", "a" * 100_000)])
    assert (one.astype(float) == got).all()


def test_risk_and_gradient_by_differences():
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=(60, 3)), np.ones(60)])
    pos, w, prior = rng.random(60) < 0.3, rng.normal(size=4), 0.6

    def risk(w):
        g = x @ w
        plus, minus = np.log1p(np.exp(-g)), np.log1p(np.exp(g))
        return prior * plus[pos].mean() + max(0.0, minus.mean() - prior * minus[pos].mean())

    halves = sum(pu.sums_at(x[a:b], pos[a:b], w) for a, b in ((0, 25), (25, 60)))
    at = pu.Risk(halves, 4)
    assert at.value(prior) == pytest.approx(risk(w)) and at.negative_part(prior) > 0
    step = 1e-6
    slope = [(risk(w + step * e) - risk(w - step * e)) / (2 * step) for e in np.eye(4)]
    assert at.unl_grad - prior * at.pos_mean == pytest.approx(slope, abs=1e-5)


def test_fit_reaches_the_least_risk():
    rng = np.random.default_rng(3)
    good = rng.random(4000) < 0.7
    x = np.column_stack([rng.normal(size=4000) + np.where(good, 1.0, -1.0), np.ones(4000)])
    pos = good & (rng.random(4000) < 0.4)
    passes = lambda w: pu.sums_at(x, pos, w)
    w = pu.newton(passes, 2, 0.7)
    at = pu.Risk(passes(w), 2)
    near = [pu.Risk(passes(w + d), 2).value(0.7) for d in rng.normal(size=(200, 2)) * 0.3]
    assert at.value(0.7) <= min(near) + 1e-3
    assert (((x @ w) > 0) == good).mean() > 0.8
    score = x @ pu.newton(passes, 2, None)
    edges = np.linspace(score.min(), score.max(), 200)
    prior = pu.best_bin(*(np.histogram(s, edges)[0].astype(float) for s in (score, score[pos])))
    assert 0.63 < prior < 0.8


def test_quality_held_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = pu.quality(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() >= 0.97
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    # Labels of held-out rows teach nothing.
    turned = labels.withColumn("quality", F.when(pu.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = pu.quality(docs, turned).toPandas()
    assert np.allclose(again.sort_values("doc_id")["score"], pu.quality(docs, labels).toPandas().sort_values("doc_id")["score"])


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a good text", "k"), (1, "a good text", None), (2, None, "x"), (None, "", "f"), (3, "BAD!! BAD!! BAD!!", "h"), (4, "more good text here", "p"), (5, "word " * 200_000, "w")],
                                 "doc_id long, text string, f string")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (2, 0, 0), (3, 0, 1), (4, 1, 0), (4, 0, 0), (9, 1, 1), (None, 1, 0)], "doc_id long, quality int, half int")
    got = pu.quality(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got) and [f for f in got[0].asDict()] == ["doc_id", "held_out", "score", "predicted"]
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert pu.quality(docs.limit(0), labels).collect() == []
    assert {r["score"] for r in pu.quality(docs, labels.where("quality = 0")).collect()} == {0.5}
