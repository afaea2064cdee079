"""N-gram Jaccard join with adaptive multi-match prefixes.

Each text is the set of its distinct five-word shingles, in one global order: rare shingles first. If two
texts reach the similarity t, any prefixes that are longer by l - 1 than the plain prefix share at least l
shingles. Every text picks its own l: a longer prefix meets more postings, but asks more shared shingles of
each candidate before the costly check. A pair has to share the smaller of its two l.

Rarity comes from a sketch of counts over all texts. Only the order and the estimates rest on it, so the
result is exact whatever its errors. Equal sets are one node from the start. Postings first give star pairs
(each text with one text of its posting), which settle most of each group of near copies; after that only
pairs between different components are candidates, so groups of copies never expand into all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .components import connected_components
from .tables import drop, save
from .words import mix, pieces, shingle_sets, split


@dataclass(frozen=True)
class JaccardJoin:
    """percent: least similarity in hundredths; words: shingle length; most_matches: largest l that is weighed;
    check_cost: cost of checking a candidate in units of reading one posting; sketch_bits: counters of the sketch;
    frequent: estimated texts from which a shingle's postings are dealt over all buckets; star_leaders: texts of a
    posting that the others meet first, by round; partners: of these, how many of the most shared each is checked against
    in a round (the last round checks all pairs that are left)."""

    percent: int = 75
    words: int = 5
    most_matches: int = 12
    check_cost: float = 500.0
    sketch_bits: int = 22
    frequent: int = 50_000
    star_leaders: tuple[int, ...] = (1, 128, 160)
    partners: tuple[int, ...] = (1, 4, 16)

    def least_overlap(self, n: np.ndarray | int):
        """Shingles that a set of n shares at least with any set that it links to."""
        return -(-self.percent * n // 100)


def _fingerprint(s: np.ndarray) -> int:
    """Names a set by a 64-bit hash of its members."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) ^ (s * s).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in pieces(batch, "text"):
        yield part, shingle_sets(split(part.column("text")), words)


def _key():
    """Names a text, so that texts of some nodes are found without making all sets again."""
    return F.xxhash64("text").alias("key")


def _profile(docs: DataFrame, p: JaccardJoin) -> DataFrame:
    """(doc_id, n_shingles, node, key) per text, and beside them the rows of the sketch with doc_id null and chunk set."""

    def run(batches):
        counts = sketch.Counters(p.sketch_bits)
        for batch in batches:
            for part, sets in _sets(batch, p.words):
                if any(len(s) for s in sets):
                    counts.add(np.concatenate(sets))
                nodes = pa.array([_fingerprint(s) if len(s) else None for s in sets], pa.int64())
                n = len(sets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), nodes, part.column("key"), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32()))], names)
        chunk, tables = counts.rows()
        n = len(chunk)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * 4, chunk, tables], names)

    names = ["doc_id", "n_shingles", "node", "key", "chunk", "counts"]
    return docs.select("doc_id", "text", _key()).mapInArrow(run, "doc_id long, n_shingles long, node long, key long, chunk int, counts array<int>")


def choose_matches(df_in_order: np.ndarray, n: int, p: JaccardJoin) -> int:
    """l with the least estimated cost. df_in_order: for each shingle of the set in global order, the other texts that hold it.

    The prefix costs its shingles and their postings. A candidate shares l of them, so it lies in l of the postings: there
    are about as many candidates as the l-th longest posting has texts.
    """
    base = n - int(p.least_overlap(n))
    most = min(p.most_matches, n - base)
    if most <= 1:
        return 1
    met = np.cumsum(df_in_order[: base + most])[base : base + most]
    ls = np.arange(1, most + 1)
    candidates = np.array([-np.partition(-df_in_order[: base + n], n - 1)[n - 1] for n in ls])
    return int(ls[np.argmin(ls + met + p.check_cost * candidates)])


def _prefix(s: np.ndarray, level: np.ndarray, expected: np.ndarray, p: JaccardJoin) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens, the texts that hold them where those are many, else 0, l) of a set's adaptive prefix."""
    own = level[(s >> np.uint64(64 - p.sketch_bits)).astype(np.int64)]
    base = len(s) - int(p.least_overlap(len(s)))
    order = np.lexsort((s, own))[: base + p.most_matches]
    others = expected[own[order]]
    need = choose_matches(others, len(s), p)
    others = others[: base + need]
    return s[order[: base + need]], np.where(others > p.frequent, others, 0), need


def _postings(docs: DataFrame, counts: np.ndarray, buckets: int, p: JaccardJoin) -> DataFrame:
    """(token, node, n, need, place, size, least) of the tokens that at least two nodes have in their prefixes.

    place counts from 0, size is the number of the token's nodes, and least marks one of them.

    Arrays travel by token bucket, one row per piece of a batch and bucket, since nearly all tokens have one
    node only. A frequent token's nodes are dealt over all buckets and pass through, so no bucket grows with the
    largest group.
    """
    noise = float(np.median(counts))
    spread = docs.sparkSession.sparkContext.broadcast(sketch.levels(counts))  # 2**sketch_bits bytes
    names = ["token", "many", "node", "n", "need", "place"]
    out = ["token", "node", "n", "need", "place", "size", "least"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected = np.maximum(np.exp2(np.arange(256) / 8) - noise - 2 * noise**0.5, 0.001)
        for batch in batches:
            for _, sets in _sets(batch, p.words):
                own = {_fingerprint(s): s for s in sets if len(s)}
                if not own:
                    continue
                found = [_prefix(s, spread.value, expected, p) for s in own.values()]
                token, many = np.concatenate([t for t, _, _ in found]), np.concatenate([f for _, f, _ in found])
                size = np.array([len(t) for t, _, _ in found])
                row = np.repeat(np.arange(len(found)), size)
                place = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
                node = np.array(list(own), dtype=np.int64)
                n, need = np.array([len(s) for s in own.values()], dtype=np.int32), np.array([x for _, _, x in found], dtype=np.int32)
                home = (mix(token) % np.uint64(buckets)).astype(np.int32)
                bucket = np.where(many > 0, (mix(node.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)[row], home)
                order = np.argsort(bucket, kind="stable")
                there, first = np.unique(bucket[order], return_index=True)
                offsets = np.append(first, len(order)).astype(np.int32)
                row = row[order]
                cols = [token[order].view(np.int64), many[order].astype(np.int64), node[row], n[row], need[row], place[order]]
                yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in cols)], ["bucket", *names])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        token, many, node, n, need, place = (np.concatenate([b.column(c).flatten().to_numpy() for b in got]) for c in names)
        order = np.lexsort((mix(node.view(np.uint64)), token))
        repeated = np.append(False, (token[order][1:] == token[order][:-1]) & (node[order][1:] == node[order][:-1]))
        order = order[~repeated]
        least = np.append(True, token[order][1:] != token[order][:-1])
        start = np.flatnonzero(least)
        size = np.repeat(np.diff(np.append(start, len(order))), np.diff(np.append(start, len(order))))
        kept = (size > 1) | (many[order] > 0)
        order, size, least = order[kept], np.maximum(size, many[order])[kept], least[kept]
        for a in range(0, len(order), 1 << 16):
            o = order[a : a + (1 << 16)]
            cols = [*(x[o] for x in (token, node, n, need, place)), size[a : a + (1 << 16)], least[a : a + (1 << 16)]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], out)

    dealt = docs.select("text").mapInArrow(deal, "bucket int, token array<long>, many array<long>, node array<long>, n array<int>, need array<int>, place array<int>")
    return dealt.groupBy("bucket").applyInArrow(shared, "token long, node long, n int, need int, place int, size long, least boolean")


def _filter(nodes: DataFrame, bits: int = 22):
    """A broadcast table of 2**bits flags that tells most other nodes from the given ones; what passes it still has to be joined."""
    return nodes.sparkSession.sparkContext.broadcast(sketch.met(nodes, "node", bits)), bits


def _passes(there, names: np.ndarray) -> np.ndarray:
    table, bits = there
    place = (names.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return (table.value[place >> 3] << (place & 7) & 128) > 0


def _needed_sets(docs: DataFrame, keys: DataFrame, nodes: DataFrame, p: JaccardJoin) -> DataFrame:
    """(node, members): the sets of the given nodes, one row per node. keys has a text's key for each node; only such texts are cut into sets."""
    there = _filter(keys.join(nodes, "node", "left_semi").select(F.col("key").alias("node")))

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            for _, sets in _sets(batch.filter(pa.array(_passes(there, batch.column("key").to_numpy()))), p.words):
                own = {_fingerprint(s): s for s in sets if len(s)}
                names = [x for x in own if x not in sent]
                sent.update(names)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([own[x].tobytes() for x in names], pa.binary())], ["node", "members"])

    found = docs.select("text", _key()).mapInArrow(run, "node long, members binary")
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _verified(pairs: DataFrame, docs: DataFrame, keys: DataFrame, p: JaccardJoin) -> DataFrame:
    """Those pairs (a, b) whose sets reach the similarity. Only the sets of these pairs are stored and shuffled."""
    pairs = save(pairs, "pairs")
    sets = save(_needed_sets(docs, keys, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), p), "sets")

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                both = int((t[at] == s).sum())
                keep.append(100 * both >= p.percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    out = save(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    drop(sets)
    drop(pairs)
    return out


def _enough(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, shared) of rows (a, b, need), a row per shared prefix token, that share as many tokens as they need."""
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("a", "b", "shared")


def _may_reach(p: JaccardJoin, o: str, matches: str) -> str:
    """Whether a shared token lies in the prefixes that a pair of just these two sizes needs.

    Such sets share at least t = percent / (100 + percent) of their summed sizes, so their first n - t + l
    tokens share at least l: for sets of nearly equal size that is far less than each one's whole prefix.
    """
    t = f"ceil({p.percent} * (n + {o}n) / {100 + p.percent})"
    return f"100 * least(n, {o}n) >= {p.percent} * greatest(n, {o}n) and place < n - {t} + {matches} and {o}place < {o}n - {t} + {matches}"


def _with_parts(postings: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Postings with each node's component so far."""
    if parts is None:
        return postings.withColumn("part", F.col("node"))
    return postings.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")


def _other(own: DataFrame) -> DataFrame:
    return own.select("token", *(F.col(c).alias(f"o_{c}") for c in ("node", "n", "need", "place", "part")))


def _star_pairs(own: DataFrame, p: JaccardJoin, leaders: int, partners: int) -> DataFrame:
    """Pairs (a, b) of each text with those of about so many texts of its postings, drawn by hash, that share most with it.

    Only texts that no path links yet are paired. A node's draw is the same in all postings, so it leads in most of
    its own. Where both texts of a pair lead, the one with the smaller node does, so a token counts once for a pair.
    """
    draw = F.xxhash64("node", F.lit(leaders)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    marked = own.withColumn("leads", F.col("least") | (F.lit(leaders > 1) & (draw * F.col("size") < leaders)))
    met = marked.join(_other(marked.where("leads")), "token").where("part <> o_part and (not leads or o_node < node)").where(_may_reach(p, "o_", "least(need, o_need)"))
    met = _enough(met.select(F.col("node").alias("a"), F.col("o_node").alias("b"), F.least("need", "o_need").alias("need")))
    best = met.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "b")), asc=False), 1, partners).alias("best"))  # few leaders a text
    best = best.select("a", F.explode("best.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _cross_pairs(own: DataFrame, p: JaccardJoin) -> DataFrame:
    """All pairs (a, b) of a posting that no path links yet and that share enough tokens. Postings of one component are left out."""
    mixed = own.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("token")
    own = own.join(mixed, "token", "left_semi")
    pairs = own.join(_other(own), "token").where("part < o_part").where(_may_reach(p, "o_", "least(need, o_need)"))
    pairs = pairs.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"), F.least("need", "o_need").alias("need"))
    return _enough(pairs).select("a", "b")


def _joined(links: DataFrame | None, found: DataFrame, parts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """All links so far and their components; the tables that they replace are dropped."""
    if links is None:
        return found, save(connected_components(found), "parts")
    if found.isEmpty():
        drop(found)
        return links, parts
    # a component's links are a star of its nodes and their least one, which is all that later rounds need
    stars = parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    both = save(stars.unionByName(found), "links")
    grown = save(connected_components(both), "parts")
    for old in (links, found, parts):
        drop(old)
    return both, grown


def similarity_classes(docs: DataFrame, p: JaccardJoin = JaccardJoin()) -> DataFrame:
    """docs(doc_id, text, ...): one row (doc_id, n_shingles, component_id) per input row.

    component_id is the least doc_id that links reach, the row's own included. Null or wordless texts have no
    shingles and stand alone, with their own doc_id; rows of equal sets (repeated rows too) are in one class;
    a null doc_id keeps its row and never is the least id of a class unless all its ids are null. Ties don't
    matter, as classes don't depend on order. Other columns are ignored, so clashing names do no harm; an
    empty table gives an empty result. Texts are used whole, at any length.
    """
    profile = save(_profile(docs, p), "profile")
    rows = profile.where("chunk is null").select("doc_id", "n_shingles", "node", "key")
    counts = sketch.collect(profile.where("chunk is not null").select("chunk", "counts"), p.sketch_bits)
    buckets = max(16, int(counts.sum()) * (100 - p.percent) // 100 // 1_000_000)
    postings = save(_postings(docs, counts, buckets, p), "postings")
    keys = save(rows.where("node is not null").groupBy("node").agg(F.min("key").alias("key")), "keys")
    links = parts = None
    for leaders, partners in zip(p.star_leaders, p.partners, strict=True):
        found = _verified(_star_pairs(_with_parts(postings, parts), p, leaders, partners), docs, keys, p)
        links, parts = _joined(links, found, parts)
    found = _verified(_cross_pairs(_with_parts(postings, parts), p), docs, keys, p)
    drop(postings)
    drop(keys)
    links, parts = _joined(links, found, parts)
    drop(links)
    own = rows.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = own.where("node is not null").groupBy("part").agg(F.min("doc_id").alias("least"))
    out = own.join(least, "part", "left")
    return out.select("doc_id", "n_shingles", F.coalesce(F.when(F.col("node").isNotNull(), F.col("least")), "doc_id").alias("component_id"))
