"""Mixing sources to target weights, by blocks of words.

A source's documents follow one another in a pseudorandom order, and their words are cut into blocks of a fixed length.
The mix is a row of slots in shards. Every source has a quota of slots, which meets its target; how many of them lie in a
shard is a multinomial draw on the condition that the totals are the quotas. It is drawn by halving the range of shards
again and again, so each shard finds its own counts, and the draws before it, from the seed alone. A source's i-th draw
takes the block to which a permutation of its blocks, one per pass, sends i, and a join by block number finds its words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import drop, partitions, save

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mixing:
    """weights: of the sources by code point, repeated; most: times a source may be repeated; block: words of one; slots: of a shard;
    bucket_rows: about the documents whose places one task counts; max_sources: bound of the sources, whose table each task holds."""

    weights: tuple[float, ...] = (1, 2, 3)
    most: int = 3
    block: int = 512
    slots: int = 4_096
    bucket_rows: int = 5_000
    max_sources: int = 1_000_000
    seed: int = 12


@dataclass
class Source:
    """A source's number, words and target, and what follows from them: its blocks, quota of draws, and the words of the last."""

    name: str | None
    number: int
    size: int
    target: float
    p: Mixing
    blocks: int = field(init=False)
    draws: int = field(init=False)
    last: int = field(init=False)

    def __post_init__(self) -> None:
        b = self.p.block
        self.blocks, wanted = -(-self.size // b), round(self.target)
        passes, rest = divmod(wanted, self.size) if wanted else (0, 0)
        short = self.size - b * (self.blocks - 1)  # words of the last block, which lies anywhere in a pass
        self.draws, self.last = passes * self.blocks, 0
        if not rest:
            self.last = self.length(self.draws - 1) if self.draws else 0
            return
        at = self.place_of(passes, self.blocks - 1)
        if rest <= b * at:
            n = -(-rest // b)
            self.last = rest - b * (n - 1)
        else:
            n = max(at + 1, -(-(rest - short) // b) + 1)
            self.last = rest - b * at if n == at + 1 else rest - b * (n - 2) - short
        self.draws += n

    def length(self, draw: int) -> int:
        return int(self.words(np.array([draw]), self.taken(np.array([draw])))[0])

    def taken(self, draws: np.ndarray) -> np.ndarray:
        """The block that each draw takes."""
        out = np.empty(len(draws), dtype=np.int64)
        turn, at = np.divmod(draws, self.blocks)
        for t in np.unique(turn):
            out[turn == t] = _permuted(at[turn == t], self.blocks, (self.p.seed, self.number, int(t)))
        return out

    def place_of(self, turn: int, block: int) -> int:
        """When a pass takes a block."""
        return int(_permuted(np.array([block]), self.blocks, (self.p.seed, self.number, turn), back=True)[0])

    def words(self, draws: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """How many words of its block each draw takes: all, but for the very last draw, which ends at the target."""
        out = np.minimum(self.size - blocks * self.p.block, self.p.block)
        return np.where(draws == self.draws - 1, self.last, out) if self.last else out


def targets(sizes: list[int], p: Mixing) -> list[float]:
    """The sources' shares of all words by weight; what is above most times a source's size is shared anew by weight, until none is above."""
    weight = [p.weights[i % len(p.weights)] for i in range(len(sizes))]
    out, rest, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        total = sum(weight[i] for i in free)
        above = {i for i in free if rest * weight[i] / total > p.most * sizes[i]}
        for i in above or free:
            out[i] = float(p.most * sizes[i]) if above else rest * weight[i] / total
        if not above:
            break
        rest -= sum(out[i] for i in above)
        free -= above
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _permuted(x: np.ndarray, n: int, key: tuple[int, ...], back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0 to n - 1, or its inverse: a Feistel network on the next even number of bits, walked until below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.SeedSequence(key).generate_state(6, np.uint64)
    x, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> bits, x[todo] & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (_mixed(left + k) & mask), left
            else:
                left, right = right, left ^ (_mixed(right + k) & mask)
        x[todo] = left << bits | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


class Plan:
    """The sources and the shards of their mix: bounded by the number of sources, whatever their sizes."""

    def __init__(self, sizes: dict[str | None, int], p: Mixing):
        names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)  # str goes by code point
        wanted = targets([sizes[s] for s in names], p)
        self.p, self.sources = p, [Source(s, i, sizes[s], t, p) for i, (s, t) in enumerate(zip(names, wanted, strict=True))]
        self.total = sum(s.draws for s in self.sources)
        self.shards = -(-self.total // p.slots)
        self._halves: dict[tuple[int, int], list[int]] = {}

    def counts(self, shard: int) -> tuple[list[int], list[int]]:
        """(draws of each source before the shard, draws of each source in it)."""
        low, high = 0, self.shards
        before, held = [0] * len(self.sources), [s.draws for s in self.sources]
        while high - low > 1:
            middle = (low + high) // 2
            if (low, high) not in self._halves:
                rng = np.random.default_rng((self.p.seed, low, high))
                self._halves[low, high] = _left_half(held, min(middle * self.p.slots, self.total) - low * self.p.slots, rng)
            left = self._halves[low, high]
            if shard < middle:
                held, high = left, middle
            else:
                before, held, low = [b + x for b, x in zip(before, left, strict=True)], [h - x for h, x in zip(held, left, strict=True)], middle
        return before, held

    def slots(self, shard: int) -> dict[str, np.ndarray]:
        """The shard's slots: source, block, and the words taken of it."""
        before, held = self.counts(shard)
        order = np.random.default_rng((self.p.seed, self.shards, shard, 1)).permutation(sum(held))
        out = {k: np.empty(len(order), dtype=np.int64) for k in ("source_no", "block", "words")}
        end = 0
        for s, b, h in zip(self.sources, before, held, strict=True):
            if h:
                draws, at = np.arange(b, b + h), order[end : end + h]
                blocks = s.taken(draws)
                out["source_no"][at], out["block"][at], out["words"][at] = s.number, blocks, s.words(draws, blocks)
                end += h
        return {"shard": np.full(len(order), shard), "slot": np.arange(len(order)), **out}


def _left_half(held: list[int], room: int, rng: np.random.Generator) -> list[int]:
    """How many of each source's draws lie in the first room of all slots, each arrangement being as likely."""
    out, rest = [], sum(held)
    for c in held:
        rest -= c
        low, high = max(0, room - rest), min(c, room)
        if low >= high:
            x = low
        elif c + rest < 10**9:  # the generator's own bound
            x = int(rng.hypergeometric(c, rest, room))
        else:
            share = c / (c + rest)
            x = min(max(round(rng.normal(room * share, math.sqrt(room * share * (1 - share) * (c + rest - room) / (c + rest)))), low), high)
        out.append(x)
        room -= x
    return out


@dataclass
class Mix:
    """placed: documents with their source's number and their first word's place in it; plan: sources and shards."""

    placed: DataFrame
    plan: Plan

    def slots(self) -> DataFrame:
        """(shard, slot, source_no, block, words): each shard's slots, found by the task that holds its number."""
        spark, plan = self.placed.sparkSession, self.plan
        spread = spark.sparkContext.broadcast(plan)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_pydict(spread.value.slots(shard))

        numbers = spark.range(0, plan.shards, 1, max(1, min(plan.shards, 4 * partitions(spark))))
        return numbers.mapInArrow(run, "shard long, slot long, source_no long, block long, words long")

    def pieces(self) -> DataFrame:
        """(source_no, start, doc_id, size, block, place, first_word, n_words): documents cut by blocks, without those that have no words."""
        length = F.lit(self.plan.p.block)
        end = F.col("start") + F.col("size")
        rows = self.placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((end - 1) / length))))
        place = F.greatest(F.col("start") - F.col("block") * length, F.lit(0))
        until = F.least(end - F.col("block") * length, length)
        return rows.select("source_no", "start", "doc_id", "size", "block", place.alias("place"), (F.col("block") * length + place - F.col("start")).alias("first_word"), (until - place).alias("n_words"))

    def spans(self) -> DataFrame:
        """(shard, slot, place, source_no, start, doc_id, first_word, n_words): what each slot takes of which document, in words."""
        met = self.slots().join(self.pieces(), ["source_no", "block"]).where("words > place")
        return met.select("shard", "slot", "place", "source_no", "start", "doc_id", "first_word", F.least("n_words", F.col("words") - F.col("place")).alias("n_words"))

    def taken(self) -> DataFrame:
        """(doc_id, source_no, size, taken) per document. A block's slots, at most one a pass, are gathered before they meet its documents."""
        drawn = self.slots().groupBy("source_no", "block").agg(F.collect_list("words").alias("draws"))
        met = self.pieces().join(drawn, ["source_no", "block"], "left")
        words = F.aggregate(F.coalesce("draws", F.array().cast("array<long>")), F.lit(0).cast("long"), lambda total, w: total + F.greatest(F.least(w - F.col("place"), F.col("n_words")), F.lit(0)))
        summed = met.groupBy("source_no", "start", "doc_id", "size").agg(F.sum(words).alias("taken"))
        empty = self.placed.where("size = 0").select("doc_id", "source_no", "size", F.lit(0).cast("long").alias("taken"))
        return summed.select("doc_id", "source_no", "size", "taken").unionByName(empty)

    def facts(self) -> DataFrame:
        """(source_no, source, source_size, target) per source."""
        rows = [(s.number, s.name, s.size, s.target) for s in self.plan.sources]
        return self.placed.sparkSession.createDataFrame(rows, "source_no long, source string, source_size long, target double")


def mix(docs: DataFrame, p: Mixing = Mixing(), keep_text: bool = False) -> Mix:
    """docs(doc_id, text, source, ...), each row a document: the plan of a mix of as many words as they have.

    Null and empty texts have no words; they stay documents. A null source is one of its own, after all others. Rows that share an id
    are documents of their own; equal rows are interchangeable. Documents of a source go by a hash of id and text. Places are running
    sums within buckets of documents on top of the buckets' own sums, so no source has to fit one task.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "text").alias("mark"), *(["text"] if keep_text else []))
    sized = save(rows, "sized")
    sums = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(p.max_sources + 1).collect()
    if len(sums) > p.max_sources:
        raise ValueError(f"more than {p.max_sources} sources: raise max_sources and the tasks' memory with it")
    plan = Plan({r.source: r.size for r in sums}, p)
    named = docs.sparkSession.createDataFrame([(s.number, s.name) for s in plan.sources], "source_no long, name string")
    buckets = max(1, -(-sized.count() // p.bucket_rows))
    dealt = sized.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("name"))).drop("source", "name")  # at most max_sources rows
    dealt = dealt.withColumn("bucket", F.pmod("mark", F.lit(buckets)))
    held = dealt.groupBy("source_no", "bucket").agg(F.sum("size").alias("held"))
    before = F.sum("held").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("source_no", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("size").over(Window.partitionBy("source_no", "bucket").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("within", within - F.col("size")).join(held, ["source_no", "bucket"])
    columns = ["doc_id", "source_no", "size", (F.col("within") + F.col("before")).alias("start"), *(["text"] if keep_text else [])]
    out = save(placed.select(*columns), "placed")
    drop(sized)
    return Mix(out, plan)


def taken_words(docs: DataFrame, p: Mixing = Mixing()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document; empty tables give none."""
    made = mix(docs, p)
    return made.taken().join(F.broadcast(made.facts()), "source_no").select("doc_id", "size", "source_size", "target", "taken")  # at most max_sources rows


def samples(docs: DataFrame, p: Mixing = Mixing()) -> DataFrame:
    """(shard, slot, source, n_words, text): the mix itself. A sample holds a block's words; texts of several documents are parted by an empty line."""
    made = mix(docs, p, keep_text=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("source_no", "block", "place", "n_words", "text")}
            for number, start, text in zip(*(b.column(k).to_pylist() for k in ("source_no", "start", "text")), strict=True):
                words = [m.span() for m in re.finditer(WORD, text)]
                first = 0
                while first < len(words):
                    block, place = divmod(start + first, p.block)
                    n = min(p.block - place, len(words) - first)
                    for k, v in zip(out, (number, block, place, n, text[words[first][0] : words[first + n - 1][1]]), strict=True):
                        out[k].append(v)
                    first += n
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("source_no", pa.int64()), ("block", pa.int64()), ("place", pa.int64()), ("n_words", pa.int64()), ("text", pa.string())]))

    pieces = made.placed.where("size > 0").select("source_no", "start", "text").mapInArrow(cut, "source_no long, block long, place long, n_words long, text string")
    met = made.slots().join(pieces, ["source_no", "block"]).where("words > place")
    room = F.col("words") - F.col("place")
    met = met.select("shard", "slot", "source_no", "place", F.least("n_words", room).alias("n_words"), _head(F.col("text"), F.col("n_words"), room).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n")
    whole = met.groupBy("shard", "slot", "source_no").agg(F.sum("n_words").alias("n_words"), joined.alias("text"))
    return whole.join(F.broadcast(made.facts()), "source_no").select("shard", "slot", "source", "n_words", "text")


def _head(text, n_words, room):
    """The text's first words where the slot ends within it."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    return F.when(n_words <= room, text).otherwise(F.array_join(F.slice(words, F.lit(1), room.cast("int")), " "))
