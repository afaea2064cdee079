"""Packing by lexical retrieval: a sharded BM25 index hands each seed document its unused neighbours.

Texts are encoded once into a table of ids. Document frequencies and the mean length are those of all documents.
Documents are dealt to shards of a bounded number of tokens by their content: by a minimum of their words'
hashes, so documents that share words tend to meet, and within one such key by row, so that no group of
copies overfills a shard. In a shard, an inverted index of words weighs them by BM25. A seed opens a sequence;
its best unused neighbours fill the window, and the last of them is cut to fit and seeds the next sequence.
Only the last sequence of a shard can be shorter than the window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .tables import save
from .words import mix, pieces, span_hashes, split, utf8


@dataclass(frozen=True)
class Packing:
    """window: tokens of a sequence; end_id closes each document; shard_tokens: about the tokens of a shard;
    neighbours: the best found that are tried before the seed asks again; k1, b: of BM25; keys: number of content
    keys, a fixed bound on what is gathered; sketch_bits: counters of document frequencies; cache_words: places for
    encoded words that a Python worker keeps."""

    window: int = 2048
    end_id: int = 1
    shard_tokens: int = 2_000_000
    neighbours: int = 32
    k1: float = 1.2
    b: float = 0.75
    keys: int = 1 << 14
    sketch_bits: int = 22
    cache_words: int = 1 << 20


#: White space beyond ASCII, as UTF-8 read as one big-endian number; in ASCII all that Python or the vocabulary's pattern takes for it.
_WIDE_2, _WIDE_3 = (np.array([int.from_bytes(chr(c).encode(), "big") for c in range(0x80, 0x3001) if chr(c).isspace() and len(chr(c).encode()) == n]) for n in (2, 3))
_ASCII = np.array([chr(c).isspace() for c in range(128)] + [False] * 128)
_OPENS = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0D])
#: ASCII letters, digits, other signs, and white space that no token takes along; 0: anything else
_LETTER, _DIGIT, _SIGN, _ALONE = 1, 2, 3, 4
_KIND = np.zeros(256, dtype=np.uint8)
for _c in range(0x21, 0x7F):
    _KIND[_c] = _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdigit() else _SIGN
_KIND[[0x09, 0x0A, 0x0D]] = _ALONE


def _cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places where one token ends and the next begins, whatever stands around: see Encoder. bounds: of the texts."""
    kind = _KIND[data]
    left, right = kind[:-1], kind[1:]
    turn = (left != right) & (left > 0) & (right > 0) & (right < _ALONE) & ~((data[:-1] == 0x27) & (right == _LETTER))
    turn[bounds[(bounds > 0) & (bounds < len(data))] - 1] = False
    opens = np.zeros(len(data), dtype=bool)
    opens[1:] = turn
    opens[:-1] |= turn & (left == _ALONE)  # the last of a run of white space is a token of its own there
    spaces = np.flatnonzero(_OPENS[data[1:]]) + 1
    opens[spaces[~_white_before(data, spaces)]] = True
    opens[0] = False
    return np.flatnonzero(opens)


def _white_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place (from 1 on) is white space."""
    out = _ASCII[data[at - 1]]
    wide = np.flatnonzero(data[at - 1] >= 0x80)
    two = data[at[wide] - 1].astype(np.int64) | data[np.maximum(at[wide] - 2, 0)].astype(np.int64) << 8
    out[wide] = np.isin(two, _WIDE_2) | np.isin(two | data[np.maximum(at[wide] - 3, 0)].astype(np.int64) << 16, _WIDE_3)
    return out


class Encoder:
    """Ids of a byte-level BPE vocabulary, by a table of encoded segments.

    The vocabulary's pattern ends a token wherever white space follows another character, around the last of a run of white space
    that isn't a space, and between ASCII letters, digits and other signs, except from an apostrophe to a letter.
    Texts are cut at such places, and the segments are encoded apart: many at once, put one after the other, where
    they begin with the only space that they hold, or hold no white space and get a line feed before
    them, which is a token of its own. The table has a place for each value of a hash's top bits, which holds the last
    segment met. Segments of over LONGEST bytes don't enter it. Texts with one of the vocabulary's special tokens are
    encoded whole.
    """

    LONGEST = 64

    def __init__(self, vocabulary: str, cache_words: int):
        import tokenizers

        self._tokenizer = tokenizers.Tokenizer.from_str(vocabulary)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._bits = (cache_words - 1).bit_length()
        self._starts = {}
        for byte, mark in ((0x20, "Ġ"), (0x0A, "Ċ")):  # how byte-level vocabularies write the two bytes
            self._starts[byte] = np.zeros(1 << 16, dtype=bool)
            for token, number in self._tokenizer.get_vocab().items():
                self._starts[byte][number] = token[:1] == mark
        self._clear()

    def _clear(self) -> None:
        self._key = np.zeros(1 << self._bits, dtype=np.uint64)
        self._first, self._size = np.zeros(1 << self._bits, dtype=np.int64), np.zeros(1 << self._bits, dtype=np.int64)
        self._pool, self._used = np.zeros(1 << 16, dtype=np.uint16), 0

    def _fresh(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint16) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, ids: np.ndarray) -> int:
        """Where the ids begin in the pool."""
        at, end = self._used, self._used + len(ids)
        if end > len(self._pool):
            self._pool = np.append(self._pool[:at], np.zeros(2 * end - at, dtype=np.uint16))
        self._pool[at:end] = ids
        self._used = end
        return at

    def _encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, size) in the pool of the ids of each segment; those set apart begin or end with anything."""
        raw = data.tobytes()
        first, size = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        spaces, blanks = (c[end] - c[start] for c in (np.append(0, np.cumsum(x)) for x in (data == 0x20, _ASCII[data])))
        rest = np.ones(len(start), dtype=bool)
        apart = apart | _white_before(data, end)
        for own, mark, starts in (
            (np.flatnonzero((data[start] == 0x20) & (spaces == 1) & ~apart), b"", self._starts[0x20]),
            (np.flatnonzero((blanks == 0) & ~apart), b"\n", self._starts[0x0A]),
        ):
            for a in range(0, len(own), 4096):
                some = own[a : a + 4096]
                (ids,) = self._fresh([b"".join([mark + raw[s:e] for s, e in zip(start[some].tolist(), end[some].tolist(), strict=True)]).decode()])
                at = np.flatnonzero(starts[ids])
                first[some], size[some] = self._keep(ids) + at + len(mark), np.diff(np.append(at, len(ids))) - len(mark)
            rest[own] = False
        left = np.flatnonzero(rest)
        found = self._fresh([raw[s:e].decode() for s, e in zip(start[left].tolist(), end[left].tolist(), strict=True)])
        if found:
            size[left] = [len(x) for x in found]
            first[left] = self._keep(np.concatenate(found)) + np.cumsum(size[left]) - size[left]
        return first, size

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit numbers."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        return [x.astype("<u2").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has (the vocabulary has fewer than 2**16)."""
        if self._used > 4 << self._bits:
            self._clear()
        data, bounds = utf8(texts)
        full = np.flatnonzero(np.diff(bounds))
        if not len(full):
            return np.zeros(0, dtype=np.uint16), np.zeros(len(texts), dtype=np.int64)
        cuts = _cuts(data, bounds)
        owner = np.searchsorted(bounds, cuts, side="right") - 1
        whole = np.zeros(len(texts), dtype=bool)
        for s in self._special:
            whole |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        opens, heads = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        opens[cuts[~whole[owner]]] = opens[bounds[full]] = heads[bounds[full]] = True
        start = np.flatnonzero(opens)
        end, head = np.append(start[1:], len(data)), heads[start]
        tail = np.append(head[1:], True)
        first, size = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        plain = np.flatnonzero(~head & ~tail & (end - start <= self.LONGEST))
        name = span_hashes(data, start[plain], end[plain])
        place = (name >> np.uint64(64 - self._bits)).astype(np.int64)
        known = (self._key[place] == name) & (self._size[place] > 0)
        first[plain[known]], size[plain[known]] = self._first[place[known]], self._size[place[known]]
        _, one, back = np.unique(name[~known], return_index=True, return_inverse=True)
        new = plain[~known][one]
        f, n = self._encode(data, start[new], end[new], np.zeros(len(new), dtype=bool))
        first[plain[~known]], size[plain[~known]] = f[back], n[back]
        at = place[~known][one]
        self._key[at], self._first[at], self._size[at] = name[~known][one], f, n
        other = np.setdiff1d(np.arange(len(start)), plain, assume_unique=True)
        first[other], size[other] = self._encode(data, start[other], end[other], (head | tail)[other])
        before = np.cumsum(size) - size
        ids = self._pool[np.repeat(first - before, size) + np.arange(size.sum())]
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[full] = np.add.reduceat(size, np.flatnonzero(head))
        return ids, counts

    @property
    def begins(self) -> np.ndarray:
        """Which ids begin a word: those of tokens that start with a space or a line feed."""
        return self._starts[0x20] | self._starts[0x0A]


_encoders: dict[int, Encoder] = {}


def _encoder(given, p: Packing) -> Encoder:
    """The worker's own encoder of a broadcast vocabulary: its cache outlives the task."""
    key = hash(given.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(given.value, p.cache_words)
    return _encoders[key]


def _content_keys(texts: pa.Array, p: Packing) -> np.ndarray:
    """A key per text: the least hash of its words, folded; 0 without words."""
    w = split(texts)
    out = np.zeros(len(texts), dtype=np.int64)
    full = np.flatnonzero(np.diff(w.first))
    if len(full):
        least = np.minimum.reduceat(mix(w.hashes ^ np.uint64(0x5BD1E995)), w.first[full])
        out[full] = (mix(least) % np.uint64(p.keys)).astype(np.int64)
    return out


def _encoded(docs: DataFrame, vocabulary, p: Packing) -> DataFrame:
    """(key, spread, doc_id, ids, n) of each row; spread, from 0 to 1, differs from row to row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, p)
        part_no, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, n = encoder.encode_column(part.column("text"))
                ids, n = np.insert(ids, np.cumsum(n), p.end_id).astype("<u2"), n + 1
                row = np.arange(done, done + len(n), dtype=np.uint64) + np.uint64(part_no << 40)
                done += len(n)
                spread = (mix(row) >> np.uint64(11)) / float(1 << 53)
                offsets = np.append(0, np.cumsum(2 * n)).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(_content_keys(part.column("text"), p)), pa.array(spread), part.column("doc_id").cast(pa.int64()), ids, pa.array(n)], ["key", "spread", "doc_id", "ids", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, spread double, doc_id long, ids binary, n long")


def _bags(ids: list[np.ndarray], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, times): the different words of each document. A word is a run of ids from one that begins a word to the next, as a hash."""
    flat = np.concatenate(ids).astype(np.int64)
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    opens = begins[flat]
    opens[first[:-1]] = True
    at = np.flatnonzero(opens)
    place = (np.arange(len(flat)) - at[np.cumsum(opens) - 1]).astype(np.uint64)
    word = mix(np.add.reduceat(mix(flat.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (place + np.uint64(1))), at))
    owner = np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((word, owner))
    owner, word = owner[order], word[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (word[1:] != word[:-1]))
    start = np.flatnonzero(new)
    return owner[start], word[start], np.diff(np.append(start, len(word)))


@dataclass
class Corpus:
    """Statistics of all documents: levels are logarithms of the frequencies of words by sketch counter."""

    documents: int
    mean_words: float
    noise: float
    levels: np.ndarray

    def frequency(self, word: np.ndarray, bits: int) -> np.ndarray:
        return np.clip(np.exp2(self.levels[(word >> np.uint64(64 - bits)).astype(np.int64)] / 8.0) - self.noise, 1, self.documents)


def _statistics(encoded: DataFrame, begins, p: Packing) -> Corpus:
    """Counts over every row: two sums and a sketch of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words, documents = sketch.Counters(p.sketch_bits), 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                ids = [np.frombuffer(x.as_buffer(), dtype="<u2") for x in batch.column("ids")[a : a + 500]]
                _, word, times = _bags(ids, begins.value)
                counts.add(word)
                words += int(times.sum())
                documents += len(ids)
        chunk, tables = counts.rows()
        n = len(chunk)
        yield pa.RecordBatch.from_arrays([chunk, tables, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], ["chunk", "counts", "words", "documents"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int32())), pa.array([words]), pa.array([documents])], ["chunk", "counts", "words", "documents"])

    found = save(encoded.select("ids").mapInArrow(run, sketch.SCHEMA + ", words long, documents long"), "word-counts")
    total = found.agg(F.sum("words").alias("words"), F.sum("documents").alias("documents")).first()
    counts = sketch.collect(found.where("chunk is not null").select("chunk", "counts"), p.sketch_bits)
    return Corpus(total.documents or 0, (total.words or 0) / max(1, total.documents or 0), float(np.median(counts)), sketch.levels(counts))


class Shard:
    """A BM25 index of documents' words, of which each document is taken once."""

    def __init__(self, ids: list[np.ndarray], begins: np.ndarray, corpus: Corpus, p: Packing):
        self.p = p
        owner, word, times = _bags(ids, begins)
        frequency = corpus.frequency(word, p.sketch_bits)
        words_of = np.bincount(owner, times, minlength=len(ids))
        _, word, here = np.unique(word, return_inverse=True, return_counts=True)
        keep = here[word] > 1  # a word of one document has no neighbours in the shard
        owner, word, times, frequency = owner[keep], word[keep], times[keep], frequency[keep]
        norm = p.k1 * (1 - p.b + p.b * words_of / max(1.0, corpus.mean_words))
        idf = np.log(1 + (corpus.documents - frequency + 0.5) / (frequency + 0.5))
        weight = idf * times * (p.k1 + 1) / (times + norm[owner])
        self.words, self.words_first = word, np.searchsorted(owner, np.arange(len(ids) + 1))
        by_word = np.argsort(word, kind="stable")
        self.posting_doc, self.posting_weight = owner[by_word], weight[by_word]
        self.posting_first = np.searchsorted(word[by_word], np.arange(len(here) + 1))
        self.free = np.ones(len(ids), dtype=bool)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the seed's words, each once."""
        asked = self.words[self.words_first[seed] : self.words_first[seed + 1]]
        a, n = self.posting_first[asked], self.posting_first[asked + 1] - self.posting_first[asked]
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return np.bincount(self.posting_doc[at], self.posting_weight[at], minlength=len(self.free))

    def neighbours(self, seed: int) -> np.ndarray:
        """The seed's best unused neighbours, best first, ties by place."""
        score = np.where(self.free, self.scores(seed), 0)
        found = np.flatnonzero(score > 0)
        if len(found) > self.p.neighbours:
            edge = np.partition(score[found], len(found) - self.p.neighbours)[len(found) - self.p.neighbours]
            found = found[score[found] >= edge]
        return found[np.lexsort((found, -score[found]))]


def pack_shard(ids: list[np.ndarray], begins: np.ndarray, corpus: Corpus, p: Packing) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece. Full windows of long documents go alone.

    Where a seed has no unused neighbour left, the longest unused document joins and is asked instead.
    """
    sequence = 0
    rest = np.zeros(len(ids), dtype=np.int64)  # where the unpacked part begins
    size = np.array([len(x) for x in ids])
    for d in np.flatnonzero(size >= p.window):
        for a in range(0, size[d] - p.window + 1, p.window):
            yield int(d), a, p.window, sequence, 0
            sequence += 1
            rest[d] = a + p.window
    index = Shard(ids, begins, corpus, p)
    index.free[rest == size] = False
    todo = np.flatnonzero(index.free)
    todo = todo[np.lexsort((todo, -(size - rest)[todo]))].tolist()[::-1]  # longest first

    def longest() -> list[int]:
        while todo:
            d = todo.pop()
            if index.free[d]:
                return [d]
        return []

    ready: list[int] = longest()
    while ready:
        filled, seed = 0, ready[0]
        ready = [seed]
        while filled < p.window:
            if not ready:
                ready = index.neighbours(seed)[::-1].tolist()
            if not ready:
                ready = longest()
                if not ready:
                    break
                seed = ready[0]
            d = ready.pop()
            index.free[d] = False
            take = int(min(size[d] - rest[d], p.window - filled))
            yield d, int(rest[d]), take, sequence, filled
            filled += take
            rest[d] += take
        sequence += 1
        ready = [d] if rest[d] < size[d] else longest()


_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def pack(docs: DataFrame, tokenizer: str, p: Packing = Packing()) -> DataFrame:
    """docs(doc_id, text, ...): (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece.

    tokenizer is the path of the vocabulary's JSON file, which travels with the job. Every row is packed, repeated
    rows too; a null text is empty (its only id is the end), a null doc_id stays null. Rows of one content key are
    dealt by their place in the input, so equal and null ids need no shard of their own. Equal scores and lengths
    are taken by place. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = f.read()
    given = spark.sparkContext.broadcast(vocabulary)
    begins = spark.sparkContext.broadcast(Encoder(vocabulary, p.cache_words).begins)
    encoded = save(_encoded(docs, given, p), "ids")
    corpus = spark.sparkContext.broadcast(_statistics(encoded, begins, p))
    sizes = np.zeros(p.keys, dtype=np.int64)
    for row in encoded.groupBy("key").agg(F.sum("n").alias("n")).collect():  # p.keys rows at most
        sizes[row.key] = row.n
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    places = spark.createDataFrame([(int(k), int(before[k]), int(sizes[k])) for k in np.flatnonzero(sizes)], "key long, before long, size long")
    shard = F.floor((F.col("before") + F.col("spread") * F.col("size")) / p.shard_tokens).cast("long")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        number = rows["shard"][0].as_py()
        order = np.lexsort((rows["spread"].to_numpy(), pc.fill_null(rows["doc_id"], -(2**62)).to_numpy()))
        doc = [rows["doc_id"][int(i)].as_py() for i in order]
        ids = [np.frombuffer(rows["ids"][int(i)].as_buffer(), dtype="<u2") for i in order]
        out = []
        for d, a, n, sequence, offset in pack_shard(ids, begins.value, corpus.value, p):
            crc = zlib.crc32(ids[d][a : a + n].astype("<u4").tobytes())
            out.append((doc[d], a, n, crc, len(ids[d]), (number << 32) + sequence, offset))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _PIECE, strict=True)], [n for n, _ in _PIECE])

    dealt = encoded.join(F.broadcast(places), "key").select(shard.alias("shard"), "spread", "doc_id", "ids")  # p.keys rows at most
    return dealt.groupBy("shard").applyInArrow(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
