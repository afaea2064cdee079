"""Whitening, mixing and clustering against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tallyloom.llm import mixing, orchard, whitening

VECTORS = "vec_id long, embedding array<float>, n int, component string"


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in e], 0, "c") for i, e in enumerate(x)] + [(i, e, 0, "c") for i, e in extra]
    return spark.createDataFrame(rows, VECTORS)


BAD = [(9000, None), (9001, []), (9002, [float("nan")] * 64), (9003, [1.0, None] * 32), (9004, [float("inf")] + [0.0] * 63), (9005, [1.0] * 63)]


def plain_clusters(rows, k=16, rounds=3):
    x = [(i, [math.floor(64 * v) for v in e]) for i, e in rows]
    first = sorted(x, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    at = [c for _, c in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        part = [nearest(v)[1] for _, v in x]
        at = [[sum(d) // len(own) for d in zip(*own)] if (own := [v for (_, v), p in zip(x, part) if p == j]) else c for j, c in enumerate(at)]
    found = [(i, *nearest(v)) for i, v in x]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), marks[j]) for i, d, j in found)


def test_orchard_equals_plain_k_means(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(260, 64)).astype(np.float32)
    x[10:90] = x[9]  # a large group of copies, first centroids among them
    x[100:130] = np.round(x[100:130])  # ties
    table = vectors(spark, x, [*BAD, (None, [0.5] * 64), (7, [0.25] * 64), (9006, [1e30] * 64)])
    rows = [(i, e.tolist()) for i, e in enumerate(x.astype(np.float64))] + [(None, [0.5] * 64), (7, [0.25] * 64)]
    assert Counter(map(tuple, orchard.cluster(table).collect())) == plain_clusters(rows)
    assert Counter(map(tuple, orchard.cluster(table.where("vec_id < 5")).collect())) == plain_clusters([r for r in rows if r[0] is not None and r[0] < 5])
    assert orchard.cluster(table.limit(0)).collect() == []
    assert orchard.cluster(table.where("vec_id between 9000 and 9005")).collect() == []


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_orchard_search_is_exact_and_skips(spread):
    rng = np.random.default_rng(spread)
    middle = rng.integers(-spread * 40, spread * 40 + 1, (40, 5))
    centroids = orchard.Centroids(np.vstack([middle, middle[:3]]))
    x = middle[rng.integers(0, 40, 500)] + rng.integers(-2, 3, (500, 5))
    best, far, taken = centroids.nearest(x)
    d = ((x[:, None, :] - centroids.at[None]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()  # argmin takes the first of equal ones
    assert taken < d.size
    assert spread < 1000 or taken < d.size / 2


def plain_whitening(x, components):
    n, dims = x.shape
    s = x.sum(axis=0)
    c = x - s.astype(np.float64) / n
    values, axes = np.linalg.eigh((c.T @ c) / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x]
    return c @ axes / np.sqrt(values), values / np.trace(c.T @ c / n), deviation


def test_whitening(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(300, 64)) @ rng.normal(size=(64, 64)) / 8 + 3).astype(np.float32)
    x[200:] = x[200]
    out = whitening.whiten(vectors(spark, x, [*BAD, (None, [0.5] * 64)])).collect()
    whole = np.floor(np.vstack([x, np.full((1, 64), 0.5)]).astype(np.float64) * 1024).astype(np.int64) + 100_000
    want, share, deviation = plain_whitening(whole, 8)
    ids = [*range(300), None]
    assert len(out) == 301 * 8 and {r.n for r in out} == {301}
    got = {(r.vec_id, r.component): r for r in out}
    for c in range(1, 9):
        column = np.array([got[i, c].whitened for i in ids])
        sign = np.sign(column @ want[:, c - 1])
        assert column * sign == pytest.approx(want[:, c - 1], abs=1e-9)
        assert got[0, c].explained == pytest.approx(share[c - 1], rel=1e-10)
    assert [got[i, 1].deviation for i in ids] == deviation
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9


def test_whitening_edges(spark):
    table = vectors(spark, np.ones((3, 4)), BAD)
    out = whitening.whiten(table.where("vec_id < 9000")).collect()
    assert len(out) == 12 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in out)
    assert whitening.whiten(table.limit(0)).collect() == []
    line = whitening.whiten(vectors(spark, [[i, 2 * i, 0.0] for i in range(5)])).collect()
    assert [r.whitened is None for r in line if r.vec_id == 0] == [False, True, True] and line[0].explained == pytest.approx(1)
    assert line[0].identity_error < 1e-12
    huge = whitening.whiten(vectors(spark, [[2.0**30], [-(2.0**30)], [2.0**60]])).collect()
    assert [(r.vec_id, r.n, r.deviation) for r in huge] == [(0, 2, None), (1, 2, None)] and abs(huge[0].whitened) == pytest.approx(1)


@pytest.mark.parametrize("kind", ["apart", "cluster", "equal", "graded"])
def test_refined_eigenvectors(kind):
    n = 48
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0].astype(np.longdouble)
    values = {
        "apart": np.linspace(1, n, n),
        "cluster": np.concatenate([5 + np.arange(12) * 1e-9, 2 + np.arange(12) * 1e-5, np.linspace(10, 20, n - 24)]),
        "equal": np.repeat([1.0, 3.0, 7.0], n // 3),
        "graded": np.logspace(-6, 6, n),
    }[kind]
    for _ in range(3):
        q = q @ (1.5 * np.eye(n) - 0.5 * q.T @ q)  # orthogonal beyond double precision
    a = q * values.astype(np.longdouble) @ q.T
    got, x = whitening.refined_eigenvectors((a + a.T) / 2)
    assert got == pytest.approx(np.sort(values)[::-1], rel=1e-13 if kind != "graded" else 1e-3, abs=1e-12)
    x = x.astype(np.longdouble)
    assert np.abs(x.T @ x - np.eye(n)).max() < 1e-15
    assert np.abs(a @ x - x * got).max() < 2e-15 * values.max() * 4
    if kind in ("apart", "cluster"):
        own = q[:, np.argsort(-values, kind="stable")]
        assert np.abs(np.abs((own * x).sum(axis=0)) - 1).max() < 1e-12
        assert np.abs(own * np.sign((own * x).sum(axis=0)) - x).max() < (1e-15 if kind == "apart" else 1e-8)


DOCS = "doc_id long, text string, source string, size int, block int"


def corpus(n=240):
    random.seed(3)
    names = ["a"] * 80 + ["b", "B", "é", "z"] * 30 + ["tiny"] + [None] * 39
    rows = [(i, " ".join(f"w{i}.{j}" for j in range(random.choice([0, 1, 2, 9, 40]))), s, 0, 0) for i, s in enumerate(names[:n])]
    rows[5] = (5, " ".join(f"w5.{j}" for j in range(3000)), "a", 0, 0)
    return [*rows, (6, None, "a", 0, 0), (None, "no id\tat\vall", "a", 0, 0), (700, "again", "b", 0, 0), (700, "again", "b", 0, 0), (800, None, "empty", 0, 0)]


def fair_targets(sizes, weights=(1, 2, 3), most=3):
    """By repeated resharing of the excess, in fractions."""
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(sizes)}
    out = {s: Fraction(sum(sizes.values())) * w / sum(weight.values()) for s, w in weight.items()}
    while any(out[s] > most * n for s, n in sizes.items()):
        over = sum(max(0, out[s] - most * n) for s, n in sizes.items())
        out = {s: min(out[s], Fraction(most * n)) for s, n in sizes.items()}
        free = [s for s, n in sizes.items() if out[s] < most * n]
        for s in free:
            out[s] += over * weight[s] / sum(weight[f] for f in free)
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix_meets_its_targets(spark):
    given = corpus()
    docs = spark.createDataFrame(given, DOCS)
    sizes = Counter()
    for _, t, s, *_ in given:
        sizes[s] += len(words(t))
    sizes = {s: sizes[s] for s in [*sorted(s for s in sizes if s is not None), None]}
    want = fair_targets(sizes)
    assert sum(want.values()) == sum(sizes.values())
    p = mixing.Mixing(block=16, slots=20, bucket_rows=30)
    out = mixing.taken_words(docs, p).collect()
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((i, len(words(t))) for i, t, *_ in given)
    source = {i: s for i, _, s, *_ in given}
    taken = Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(float(want[s])) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert Counter(map(tuple, out)) == Counter(map(tuple, mixing.taken_words(docs.repartition(7), p).collect()))
    assert mixing.taken_words(docs.limit(0)).collect() == []
    assert [tuple(r) for r in mixing.taken_words(docs.where("doc_id = 800")).collect()] == [(800, 0, 0, 0.0, 0)]


def test_samples_hold_what_is_taken(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    p = mixing.Mixing(block=16, slots=20, bucket_rows=30)
    out = mixing.samples(docs, p).collect()
    assert all(len(words(r.text)) == r.n_words <= 16 for r in out)
    by_doc = Counter(int(w[1:].split(".")[0]) for r in out for w in words(r.text) if re.fullmatch(r"w\d+\.\d+", w))
    want = {r.doc_id: r.taken for r in mixing.taken_words(docs, p).where("doc_id is not null").collect() if r.taken}
    assert {d: n for d, n in want.items() if d < 700} == by_doc
    spans = mixing.mix(docs, p).spans().collect()
    assert sum(r.n_words for r in spans) == sum(r.n_words for r in out)
    slots = Counter((r.shard, r.slot) for r in out)
    assert set(slots.values()) == {1} and sorted(slots) == sorted((n // 20, n % 20) for n in range(len(slots)))


def test_a_permutation_and_its_inverse():
    for n in (1, 2, 3, 7, 64, 1000):
        got = mixing._permuted(np.arange(n), n, (1, 2, 3))
        assert sorted(got.tolist()) == list(range(n))
        assert mixing._permuted(got, n, (1, 2, 3), back=True).tolist() == list(range(n))
    assert mixing._permuted(np.arange(1000), 1000, (1, 2, 3)).tolist() != mixing._permuted(np.arange(1000), 1000, (1, 2, 4)).tolist()


def test_quotas_end_at_the_target():
    for size in (1, 5, 16, 17, 100, 161):
        for target in range(0, 3 * size + 1):
            s = mixing.Source("s", 1, size, float(target), mixing.Mixing(block=16))
            draws = np.arange(s.draws)
            blocks = s.taken(draws) if s.draws else draws
            assert (s.words(draws, blocks).sum() if s.draws else 0) == target
            assert max(Counter(blocks.tolist()).values(), default=0) <= 3


def test_shards_share_the_quotas():
    plan = mixing.Plan({f"s{i}": 10_000 * (i + 1) for i in range(9)}, mixing.Mixing(block=16, slots=100))
    before = [0] * 9
    rows = []
    for shard in range(plan.shards):
        seen, held = plan.counts(shard)
        assert seen == before and sum(held) in (100, plan.total - 100 * shard)
        before = [b + h for b, h in zip(before, held)]
        rows.append(held)
    assert before == [s.draws for s in plan.sources]
    share = np.array(before) / plan.total
    spread = np.array(rows[:-1]).var(axis=0) / (100 * share * (1 - share))  # about 1 for a multinomial draw
    assert (spread > 0.6).all() and (spread < 1.5).all()


def test_halves_beyond_the_generators_bound():
    rng = np.random.default_rng(0)
    held = [3 * 10**9, 5, 10**10, 0]
    left = mixing._left_half(held, 6 * 10**9, rng)
    assert sum(left) == 6 * 10**9 and all(0 <= x <= h for x, h in zip(left, held))
