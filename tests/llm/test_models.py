"""Language model, classifier, packing and search against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import hmm_lm, kmeans_tree, packing, quality
from tallyloom.llm.queries import tokenizer
from tallyloom.llm.tables import crc32_text

DOCS = "doc_id long, text string, score string, held_out int"


def texts(n=60):
    random.seed(4)
    voc = [[f"{c}{i}" for i in range(60)] for c in ("ta", "ku")]
    return [" ".join(random.choices(voc[i % 2], k=random.randint(1, 90))) for i in range(n)] + [None, "", "Unseen WORDS ta1", " ".join(random.choices(voc[0], k=1500))]


def plain_forward(seq, m):
    a = m.start * m.emit[:, seq[0]]
    log = 0.0
    for s in seq[1:]:
        log += math.log(a.sum())
        a = (a / a.sum()) @ m.move * m.emit[:, s]
    return (log + math.log(a.sum())) / math.log(10)


@pytest.mark.parametrize("chunk", [7, 64])
def test_forward_is_exact(chunk):
    p = hmm_lm.HiddenMarkov(states=3, frequent=10, classes=10, chunk=chunk)
    rng = np.random.default_rng(1)
    m = hmm_lm.Parameters(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(20), 3))
    seqs = [rng.integers(0, 20, n) for n in (1, 5, 7, 8, 40, 200)]
    first = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    got = hmm_lm.log10_likelihood(np.concatenate(seqs), first, m, p)
    assert got == pytest.approx([plain_forward(s, m) for s in seqs], rel=1e-10)


def test_expected_counts_sum_up():
    p = hmm_lm.HiddenMarkov(states=3, frequent=10, classes=10, window=16)
    rng = np.random.default_rng(2)
    m = hmm_lm.Parameters(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(20), 3))
    flat, first = rng.integers(0, 20, 100), np.array([0, 30, 31, 100])
    starts, moves, emissions = hmm_lm.expected_counts(flat, first, m, p)
    windows = 2 + 1 + 5
    assert starts.sum() == pytest.approx(windows) and moves.sum() == pytest.approx(100 - windows)
    assert emissions.sum(axis=0) == pytest.approx(np.bincount(flat, minlength=20))


def test_language_model(spark):
    given = texts()
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(given)], DOCS)
    out = {r.doc_id: r for r in hmm_lm.score(docs, crc32_text(F.col("doc_id")) % 7 == 2, hmm_lm.HiddenMarkov(states=2, frequent=64, classes=16, home_bytes=4000)).collect()}
    words = {i: [*(t or "").lower().split(), "\n"] for i, t in enumerate(given)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    count = {}
    for i, ws in words.items():
        for w in ws if not held[i] else []:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, ws in words.items():
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in count for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in ws))
    late = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in late) > sum(r.base_score for r in late)  # two languages are two states
    assert hmm_lm.score(docs.limit(0), F.lit(False)).count() == 0


def test_quality(spark):
    random.seed(6)
    good = [" ".join(random.choices("the of and cat dog river stone walks sings".split(), k=40)) for _ in range(60)]
    bad = [" ".join(w + "***" for w in random.choices("the of and cat dog river stone".split(), k=40)) for _ in range(40)] + ["spam " * 50] * 20
    rows = [(i, t, "c", 0) for i, t in enumerate(good + bad)] + [(900, None, "c", 0), (901, "", "c", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 120, 2)] + [(1, None), (None, 1)], "doc_id long, quality int")
    p = quality.Subwords(buckets=1 << 12)
    model = quality.fit(quality.with_labels(docs, labels, "quality", p), p)
    out = {r.doc_id: r for r in quality.score(docs, model, p).collect()}
    assert all(out[i].predicted == int(i < 60) for i in range(1, 120, 2))
    assert out[900].score == out[901].score and 0 <= out[900].score <= 1
    empty = quality.fit(quality.with_labels(docs, labels.limit(0), "quality", p), p)
    assert {r.score for r in quality.score(docs, empty, p).collect()} == {0.5}


def test_averages_match_the_training_features():
    p = quality.Subwords(buckets=1 << 10)
    vectors = np.random.default_rng(0).normal(size=(p.buckets + p.pair_buckets, p.width)).astype(np.float32)
    given = ["One two TWO two two three", "", "a b c a b c a b c", "x", "été Été 中文 été"]
    want = [share @ vectors[bucket] for bucket, share in (quality._text_features(t, p) for t in given)]
    assert quality.averages(pa.array(given), vectors, p) == pytest.approx(np.array(want), abs=1e-5)


def test_averages_against_plain_text():
    """The mean over a text's words and n-grams of their vectors, found by strings, plus the different pairs over all pairs."""
    p = quality.Subwords(buckets=1 << 16, width=1)
    text = "été Zoo été Zoo naïve"
    names: dict[str, int] = {}
    t = quality._read(pa.array([text], pa.string()), p)
    raw = text.split()
    grams = [["whole " + w, *(f" {w} "[i : i + n] for n in p.grams for i in range(len(w) + 3 - n))] for w in raw]
    bucket, owner, _ = quality._word_features([w.encode() for w in raw], p)
    for i, g in enumerate(grams):
        assert len(g) == (owner == i).sum()
        for name, b in zip(g, bucket[owner == i], strict=True):
            assert names.setdefault(name, int(b)) == b
    assert t.pairs.tolist() == [4] and len(t.pair_bucket) == 3  # "Zoo été" and "été Zoo" twice, "Zoo naïve"
    vectors = np.random.default_rng(1).normal(size=(p.buckets + p.pair_buckets, 1))
    every = [vectors[names[x], 0] for g in grams for x in g]
    want = sum(every) / len(every) + vectors[t.pair_bucket, 0].sum() / 4
    assert quality.averages(pa.array([text]), vectors, p)[0, 0] == pytest.approx(want)


def test_encoder_equals_the_tokenizer():
    encoder = packing.Encoder(open(tokenizer(), encoding="utf-8").read(), 100)
    reference = Tokenizer.from_file(tokenizer())
    given = [*filter(None, texts(8)), "", "a  b", " lead", "trail ", "x\n\n y\t z", "don't it's", "é çà ñ 中文 ok", "a \n b", " x   y", "3.14, (x)!! ***", "a <|endoftext|> b", "x<|endoftext|>", "\xe9\n\xe9\u2003 \xa0 \xa0"]
    spaces = " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2003\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
    random.seed(9)
    for _ in range(3000):
        given.append("".join(random.choices([" ", *spaces, "a", "B", "é", "7", "'s", "!", "中", "<|endoftext|>"], weights=[8, *[0.3] * len(spaces), 4, 2, 2, 2, 1, 2, 1, 0.1], k=random.randint(1, 14))))
    for _ in range(2):  # the second time from the cache
        for t, ids in zip(given, encoder.encode(given), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == reference.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_meets_parts_of_words_once():
    """Known words next to other signs and digits aren't encoded again, and a text's end doesn't look at the next text."""
    encoder = packing.Encoder(open(tokenizer(), encoding="utf-8").read(), 1 << 16)
    reference = Tokenizer.from_file(tokenizer())
    encoder.encode(["x alpha beta, (gamma) (delta-epsilon) 12;\n34 x"])
    sent = []
    fresh = encoder._fresh
    encoder._fresh = lambda texts: sent.extend(texts) or fresh(texts)
    given = ["x alpha, beta (delta-gamma)34;\n12 x", "x alpha\r\n\n", "(x alpha's\xa0", " x"]
    for t, ids in zip(given, encoder.encode(given), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == reference.encode(t, add_special_tokens=False).ids, repr(t)
    assert not any(w in t for w in ("alpha,", "beta", "gamma", "delta", "34") for t in sent)


def test_packing(spark):
    given = [*texts(150), "long " * 5000]
    docs = spark.createDataFrame([(i, t, "c", 0) for i, t in enumerate(given)] + [(None, "no id", "c", 0), (3, given[3], "c", 0)], DOCS)
    out = packing.pack(docs, tokenizer(), packing.Packing(shard_tokens=6000)).collect()
    reference = Tokenizer.from_file(tokenizer())
    ids = {i: np.array([*reference.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in enumerate(given)}
    seen = {i: np.zeros(len(x), int) for i, x in ids.items()}
    for r in out:
        if r.doc_id is not None:
            part = ids[r.doc_id][r.start : r.start + r.length]
            assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(part.tobytes())
            seen[r.doc_id][r.start : r.start + r.length] += 1
    assert all((x == (2 if i == 3 else 1)).all() for i, x in seen.items())
    sequences = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert sequences.setdefault(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] += r.length
    short = [s for s, n in sequences.items() if n < 2048]
    assert max(sequences.values()) == 2048 and len({s >> 32 for s in short}) == len(short)
    assert packing.pack(docs.limit(0), tokenizer()).count() == 0


def plain_bm25(bags, seed, p):
    """Of every document, by definition: the sum over the seed's different words."""
    n, mean = len(bags), sum(sum(x.values()) for x in bags) / len(bags)
    df = Counter(w for x in bags for w in x)
    out = []
    for x in bags:
        norm = p.k1 * (1 - p.b + p.b * sum(x.values()) / mean)
        out.append(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * x[w] * (p.k1 + 1) / (x[w] + norm) for w in bags[seed] if w in x and df[w] > 1))
    return out


def test_neighbours_by_bm25():
    p = packing.Packing(neighbours=3)
    encoder = packing.Encoder(open(tokenizer(), encoding="utf-8").read(), 100)
    random.seed(11)
    given = [" " + " ".join(random.choices("fox den sea ship hole port river stone night crow".split(), k=random.randint(1, 9))) for _ in range(25)]
    ids = [np.frombuffer(x, "<u2") for x in encoder.encode(given)]
    bags = [Counter(t.split()) for t in given]
    df = Counter(w for x in bags for w in x)
    _, word, _ = packing._bags(ids, encoder.begins)
    levels = np.zeros(1 << p.sketch_bits)
    for w, n in zip(*np.unique(word, return_counts=True), strict=True):
        levels[int(w) >> (64 - p.sketch_bits)] = math.log2(n) * 8
    assert sorted(df.values()) == sorted(np.unique(word, return_counts=True)[1].tolist())
    corpus = packing.Corpus(len(ids), sum(sum(x.values()) for x in bags) / len(ids), 0.0, levels)
    index = packing.Shard(ids, encoder.begins, corpus, p)
    for seed in range(len(ids)):
        want = plain_bm25(bags, seed, p)
        assert index.scores(seed) == pytest.approx(want)
        index.free[:] = True
        index.free[[seed, (seed + 1) % 25]] = False
        best = sorted((d for d in range(25) if index.free[d] and want[d] > 0), key=lambda d: (-round(want[d], 9), d))
        assert [round(want[d], 9) for d in index.neighbours(seed)[:3]] == [round(want[d], 9) for d in best[:3]]


def test_packing_follows_the_seed():
    p = packing.Packing(window=10)
    encoder = packing.Encoder(open(tokenizer(), encoding="utf-8").read(), 100)
    ids = [np.frombuffer(x, "<u2") for x in encoder.encode([" red fox red fox red fox", " blue sea ship sea", " red fox den", " ship sea port", " lone"])]
    corpus = packing.Corpus(5, 4.0, 0.0, np.zeros(1 << p.sketch_bits))
    got = list(packing.pack_shard(ids, encoder.begins, corpus, p))
    assert [d for d, *_ in got][:2] == [0, 2]
    for d, x in enumerate(ids):
        assert sorted(i for e, a, n, *_ in got if e == d for i in range(a, a + n)) == list(range(len(x)))


def test_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[5:300] = x[4]
    rows = [(i, [float(v) for v in e], "c") for i, e in enumerate(x)] + [(2000, None, "c"), (2001, [0.0] * 16, "c"), (2002, [float("nan")] * 16, "c"), (2003, [1.0, None] * 8, "c"), (2004, [1.0], "c"), (None, [1.0] * 16, "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string")
    out = kmeans_tree.search(table, F.col("vec_id") % 20 == 0, kmeans_tree.KMeansTree(leaf_rows=30, sample=500)).collect()
    found = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(range(0, 900, 20))
    x, hits = x.astype(np.float64), 0
    for q, got in found.items():
        s = (x * x[q]).sum(axis=1)
        others = np.delete(np.arange(900), q)
        want = others[np.lexsort((others, -s[others]))][:20]
        assert len(got) == 20 and all(abs(s[v] - z) < 1e-12 for v, z in got)
        assert [v for v, _ in got] == sorted([v for v, _ in got], key=lambda v: (-s[v], v))
        hits += len(set(want.tolist()) & {v for v, _ in got})
    assert hits >= 0.9 * 20 * len(found)
    assert kmeans_tree.search(table.limit(0), F.lit(True)).count() == 0
