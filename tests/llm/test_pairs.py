"""Jaccard join, line deduplication and decontamination against brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from tallyloom.llm import components, decontam, jaccard_join, line_dedup, queries

DOCS = "doc_id long, text string, node string, part string, token long"  # the last columns clash with inner names


def rows(*texts):
    return [(i, t, "x", None, 1) for i, t in enumerate(texts)]


def unions(ids, pairs):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def corpus():
    random.seed(3)
    base = [[f"w{random.randint(0, 400)}" for _ in range(60)] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(6):
            copy = list(b)
            for _ in range(random.randint(0, 3)):
                copy[random.randrange(60)] = f"v{random.randint(0, 99)}"
            texts.append(" ".join(copy))
    return [*texts, texts[0], texts[0].upper(), None, "", " \n", "one two", "One  two", "x " * 5000]


def test_jaccard_classes(spark):
    texts = corpus()
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = unions(sets, links)
    for p in (jaccard_join.JaccardJoin(), jaccard_join.JaccardJoin(frequent=3, star_leaders=(1,), partners=(1,), most_matches=3)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_classes(spark.createDataFrame(rows(*texts), DOCS), p).collect()}
        assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_prefix_tokens_keep_all_their_bits(spark):
    """Two tokens that differ in their last bits only count as two."""
    p = jaccard_join.JaccardJoin()
    docs = spark.createDataFrame(rows(*corpus()), DOCS)
    counts = np.zeros(1 << p.sketch_bits, dtype=np.int64)
    tokens = {r.token for r in jaccard_join._postings(docs, counts, 16, p).collect()}
    made = {int(t) for s in jaccard_join.shingle_sets(jaccard_join.split(jaccard_join.pa.array(corpus()))) for t in s.view(np.int64)}
    assert tokens and tokens <= made


def test_only_sets_of_paired_texts_are_made(spark, monkeypatch):
    """Texts that share rare shingles but can't reach the similarity meet in postings; their sets aren't stored."""
    random.seed(21)
    word = lambda: f"w{random.randint(0, 10**6)}"
    texts = []
    for _ in range(40):
        shared = [word() for _ in range(6)]
        texts += [" ".join([*shared, *(word() for _ in range(k))]) for k in (60, 200)]
    twin = [word() for _ in range(80)]
    texts += [" ".join(twin), " ".join([*twin, "end"])]
    made = []
    save = jaccard_join.save
    monkeypatch.setattr(jaccard_join, "save", lambda df, name: made.append((name, save(df, name))) or made[-1][1])
    monkeypatch.setattr(jaccard_join, "drop", lambda df: None)
    got = {r.doc_id: r.component_id for r in jaccard_join.similarity_classes(spark.createDataFrame(rows(*texts), DOCS)).collect()}
    assert got == {i: min(i, 80) for i in range(82)}
    assert max(df.count() for name, df in made if name == "sets") == 2


def test_a_sketch_is_collected_in_one_job(spark):
    docs = spark.range(5000).select(jaccard_join.F.shiftleft("id", 45).alias("node"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sketch", "")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        bits = np.unpackbits(jaccard_join.sketch.met(docs, "node", 22))
        assert len(tracker.getJobIdsForGroup("sketch")) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = np.zeros(1 << 22, dtype=bool)
    want[(np.arange(5000, dtype=np.uint64) << np.uint64(45)) >> np.uint64(42)] = True
    assert np.array_equal(bits.astype(bool), want)


def test_jaccard_of_nothing_and_of_null_ids(spark):
    assert jaccard_join.similarity_classes(spark.createDataFrame([], DOCS)).count() == 0
    out = jaccard_join.similarity_classes(spark.createDataFrame([(None, "a b", "", "", 1), (7, "a b", "", "", 1), (7, "a b", "", "", 1)], DOCS)).collect()
    assert sorted(r.component_id for r in out) == [7, 7, 7]


def test_choice_of_matches():
    p = jaccard_join.JaccardJoin()
    assert jaccard_join.choose_matches(np.full(60, 0.0), 100, p) == 1
    assert jaccard_join.choose_matches(np.array([0.0] * 20 + [1000.0] + [1.0] * 39), 100, p) == 2


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), *((i, i + 1) for i in range(20, 60))]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, **{i: 20 for i in range(20, 61)}}


def line_sets(text, k=10):
    return {text[i : i + k] for i in range(len(text) - k + 1)} or {text}


def test_lines(spark):
    random.seed(5)
    lines = [" ".join(random.choice("alpha beta gamma delta omega sigma kappa lambda".split()) + str(random.randint(0, 30)) for _ in range(14)) for _ in range(30)]
    near = [re.sub(r"\d+$", "77", x) for x in lines[:15]]
    texts = ["\n".join(random.sample(lines + near, 6) + ["short", ""]) for _ in range(20)] + [None, "", lines[0].upper() + "  \n" + "z" * 600]
    p = line_dedup.LineDedup(bands=30, rows=2, star_leaders=(1,))
    found = [((d, n), x.strip(" ").lower()) for d, t in enumerate(texts) if t is not None for n, x in enumerate(t.split("\n"))]
    found = [(at, x) for at, x in found if x]
    names = sorted({x for _, x in found})
    sets = [line_sets(x) for x in names]
    links = [(a, b) for a, b in itertools.combinations(range(len(names)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    part = unions(range(len(names)), links)
    first, want = {}, {}
    for at, x in found:
        c = part[names.index(x)]
        if c in first:
            want.setdefault(at[0], []).append(at[1])
        first.setdefault(c, at)
    docs = spark.createDataFrame(rows(*texts), DOCS)
    assert {r.doc_id: r.dropped for r in line_dedup.dropped_lines(docs, p).collect()} == want
    rebuilt = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(docs, p).collect()}
    assert rebuilt == {d: t if d not in want else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[d]) for d, t in enumerate(texts)}
    assert line_dedup.dropped_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_lines_by_all_shingles_with_production_parameters(spark):
    random.seed(8)
    words = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(2, 9))) for _ in range(5000)]
    pairs, want = [], []
    while len(pairs) < 600:
        x = " ".join(random.choices(words, k=random.choice((2, 3, 4, 6, 9, 12, 16, 18, 22, 40))))
        y = list(x)
        for _ in range(random.randint(1, 1 + len(x) // 60)):
            at = random.randrange(len(y))
            y[at : at + 1] = random.choice((["#"], ["#", "#"], []))
        y = "".join(y).strip()
        a, b = (line_sets(t) for t in (x, y))
        if x != y and 0.6 < len(a & b) / len(a | b) < 0.88:
            pairs.append((x, y))
            want.append(100 * len(a & b) >= 75 * len(a | b))
    texts = [t for pair in pairs for t in pair]
    gone = {r.doc_id for r in line_dedup.dropped_lines(spark.createDataFrame(rows(*texts), DOCS)).collect()}
    got = [2 * i + 1 in gone for i in range(len(pairs))]
    assert not [i for i in range(len(pairs)) if got[i] and not want[i]] and not [d for d in gone if d % 2 == 0]
    assert sum(got) >= 0.98 * sum(want) > 100


def test_repetitive_and_long_lines(spark):
    """Equal and similar sets of lines of very different lengths, and long lines, which sign with a part of their shingles."""
    random.seed(10)
    texts = ["ha " * 20, "ha " * 60, "=-" * 15, "=-" * 400, "0123456789" * 30, "0123456789" * 300 + "01"]
    words = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(2, 9))) for _ in range(3000)]
    for n in range(120):
        x = " ".join(random.choices(words, k=random.choice((20, 24, 45, 50, 90, 200, 400))))
        y = x.split()
        for at in random.sample(range(len(y)), max(1, len(y) // 30)):
            y[at] = random.choice(words)
        y = " ".join(y) + x[: len(x) // 6] * (n % 3 == 0)
        if len(line_sets(x) & line_sets(y)) >= 0.75 * len(line_sets(x) | line_sets(y)):
            texts += [x, y]
    gone = {r.doc_id for r in line_dedup.dropped_lines(spark.createDataFrame(rows(*texts), DOCS)).collect()}
    assert all(d % 2 for d in gone) and {1, 3, 5} <= gone
    assert len(texts) > 160 and len(gone) >= 0.99 * len(texts) / 2


def test_a_band_of_unlike_lines_is_not_paired(spark):
    """Copies of one line with edits of their own: near the base, not near each other."""
    random.seed(13)
    base = " ".join("".join(random.choices("abcdefghijklmnop", k=6)) for _ in range(14))
    made = []
    for _ in range(150):
        words = base.split()
        for at in random.sample(range(14), 2):
            words[at] = "".join(random.choices("qrstuvwxyz", k=6))
        made.append(" ".join(words))
    docs = spark.createDataFrame(rows(*made), DOCS)
    p = line_dedup.LineDedup()
    nodes = line_dedup.lines(docs, 1).select("node", "line").distinct()
    texts = nodes.withColumn("n", line_dedup.F.size(line_dedup.F.array_distinct(line_dedup.shingles(line_dedup.F.col("line"), p))))
    own = nodes.withColumn("part", line_dedup.F.col("node"))
    named = {r.node: line_sets(r.line) for r in nodes.collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(named), 2) if 100 * len(named[a] & named[b]) >= 75 * len(named[a] | named[b])}
    met = {(r.a, r.b) for r in line_dedup._crossing(own, texts, p).collect()}
    assert want <= met and len(met) < 150 * 149 / 8


def test_short_lines(spark, tmp_path):
    texts = ["Short one\n\nshort two\n", " short ONE \n\nshort twos", None, "short one\nshort one"]
    spark.createDataFrame(rows(*texts), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r.dropped for r in queries.op4_fuzzy_line_dedup(spark, str(tmp_path)).collect()}
    assert out == {0: "", 1: "0", 2: "", 3: "0,1"}


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        old, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (c != d)))
    return min(row)


@pytest.mark.parametrize("seed", range(20))
def test_myers(seed):
    random.seed(seed)
    item = "".join(random.choices("abc", k=random.randint(1, 90)))
    text = "".join(random.choices("abc", k=random.randint(0, 120)))
    assert decontam.myers(item, text)[0] == distance(item, text)


def test_decontamination(spark):
    random.seed(2)
    word = lambda: "".join(random.choices("abcdefgh", k=5))
    items = [" ".join(word() for _ in range(20)) for _ in range(4)]
    edited = items[1][:30] + "X" + items[1][31:60] + items[1][62:]
    texts = [f"{word()} {items[0].upper()}\n{word()}", f"{word()} {edited} tail", word(), items[2][:60], None, "", items[3].replace(" ", " \n\t")]
    docs = spark.createDataFrame([(i, t, "c", 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id string, distance int")
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    for p in (decontam.EditMatch(), decontam.EditMatch(block_chars=100)):
        got = {(r.doc_id, r.item_id): r.distance for r in decontam.matches(docs, bench, p).collect()}
        want = {(d, i): distance(decontam.normal(x), decontam.normal(t)) for d, t in enumerate(texts) for i, x in enumerate(items)}
        assert got == {k: v for k, v in want.items() if v <= decontam.budget(decontam.normal(items[k[1]]), p)}
        assert set(got) == {(0, 0), (1, 1), (6, 3)}
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {2, 3, 4, 5}
    assert decontam.matches(docs, bench.limit(0)).count() == 0 and decontam.matches(docs.limit(0), bench).count() == 0
