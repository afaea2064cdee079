"""Quality classifier: supervised subword embeddings.

A text is the average of its words' vectors plus the average of its word pairs' vectors. A word's vector is the sum
of the learned vectors of its own hash bucket and of the buckets of its character n-grams (of the word between two
markers, case kept); two words in a row have the learned vector of their pair's bucket
(few buckets, which unseen pairs share). Pairs have binary weights: in the sum each different pair of a text stands once, while
the divisor counts all, so this second average falls as a text repeats itself. With so few buckets it is a feature of its own, a
learned weight of repetition, beside the averaged vectors of words and n-grams. A softmax over the average gives the
classes. Training is stochastic gradient descent in numpy, inside one task, over a bounded sample of labelled texts;
scoring runs over all partitions with the broadcast model, whose size is fixed by its parameters.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, mix, pieces, split


@dataclass(frozen=True)
class Subwords:
    """buckets, pair_buckets, width: hashed vectors of words and n-grams, those of word pairs, and their length; grams: n-gram lengths in characters; max_training_texts: bound
    of the labelled sample (the texts of least id hash; all labelled texts if fewer); rate, vector_rate: first
    learning rates of the softmax and of the vectors. pair_buckets is the best of five sizes on a fifth of the training rows, held back for that."""

    buckets: int = 1 << 17
    pair_buckets: int = 1 << 6
    width: int = 8
    grams: tuple[int, ...] = (3, 4, 5)
    max_training_texts: int = 3000
    epochs: int = 8
    rate: float = 0.5
    vector_rate: float = 20.0
    seed: int = 7


@dataclass
class Model:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MARK = 0x20  # never inside a word


def _word_features(words: list[bytes], p: Subwords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word) pairs of the given words, for each word itself and its n-grams, and a hash of each word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = b" ".join([b"", *words, b""]).decode("utf-8", "replace")
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    mark = codes == _MARK
    marks = np.cumsum(mark)
    value = mix((codes.astype(np.uint64) + np.uint64(1)) * _ODD)
    first = np.flatnonzero(mark)[:-1]
    place = (np.arange(len(codes)) - np.append(first, len(codes))[marks - 1]).astype(np.uint64)
    whole = mix(np.add.reduceat((value * mix(place + np.uint64(77)))[:-1], first))
    found, owner = [whole], [np.arange(len(words))]
    for n in p.grams:
        if len(codes) < n:
            continue
        start = np.arange(len(codes) - n + 1)
        start = start[marks[start + n - 2] == marks[start]]  # no mark but at either end
        h = np.zeros(len(start), dtype=np.uint64)
        for i in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + value[start + i]
        found.append(mix(h + np.uint64(n)))
        owner.append(marks[start] - 1)
    return (np.concatenate(found) % np.uint64(p.buckets)).astype(np.int64), np.concatenate(owner), whole


@dataclass
class _Texts:
    """Words of some texts: w as split; number: each word's place among the distinct ones, whose features are bucket, owner;
    pair_text, pair_bucket: the different pairs of each text; pairs: how many each text has in all."""

    w: Words
    number: np.ndarray
    distinct: int
    bucket: np.ndarray
    owner: np.ndarray
    pair_text: np.ndarray
    pair_bucket: np.ndarray
    pairs: np.ndarray


def _read(texts: pa.Array, p: Subwords) -> _Texts:
    w = split(texts)
    _, where, number = np.unique(w.hashes + _case(w), return_index=True, return_inverse=True)
    raw = w.data.tobytes()
    bucket, owner, whole = _word_features([raw[a:b] for a, b in zip(w.start[where].tolist(), w.end[where].tolist(), strict=True)], p)
    words = np.diff(w.first)
    text = np.repeat(np.arange(len(words)), words)
    h = whole[number] if len(number) else np.zeros(0, np.uint64)
    joined = (text[1:] == text[:-1]) if len(text) else np.zeros(0, bool)
    pair = mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(5))[joined]
    pair_text = text[1:][joined]
    _, once = np.unique(mix(pair + pair_text.astype(np.uint64) * _ODD), return_index=True)
    return _Texts(w, number, len(where), bucket, owner, pair_text[once], (pair[once] % np.uint64(p.pair_buckets)).astype(np.int64) + p.buckets, np.maximum(words - 1, 0))


def _case(w: Words) -> np.ndarray:
    """Differs for words that differ in the case of letters only."""
    upper = ((w.data >= 65) & (w.data <= 90)).astype(np.uint64) * (np.arange(len(w.data), dtype=np.uint64) + np.uint64(1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(upper)])
    count = np.concatenate([np.zeros(1, np.uint64), np.cumsum((upper > 0).astype(np.uint64))])
    n = count[w.end] - count[w.start]
    return mix((total[w.end] - total[w.start]) - n * w.start.astype(np.uint64)) * n


def averages(texts: pa.Array, vectors: np.ndarray, p: Subwords) -> np.ndarray:
    """The averaged vector of each text (zero for a text without words)."""
    t = _read(texts, p)
    n = len(t.w.first) - 1
    own = np.stack([np.bincount(t.owner, vectors[t.bucket, k], minlength=t.distinct) for k in range(p.width)] + [np.bincount(t.owner, minlength=t.distinct)], axis=1)
    total = np.concatenate([np.zeros((1, p.width + 1)), np.cumsum(own[t.number], axis=0)])
    total = total[t.w.first[1:]] - total[t.w.first[:-1]]
    pairs = np.stack([np.bincount(t.pair_text, vectors[t.pair_bucket, k], minlength=n) for k in range(p.width)], axis=1)
    return total[:, :-1] / np.maximum(total[:, -1:], 1) + pairs / np.maximum(t.pairs, 1)[:, None]


def _text_features(text: str, p: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text with their weights in its average."""
    t = _read(pa.array([text], pa.string()), p)
    times = np.bincount(t.number, minlength=t.distinct)[t.owner]
    bucket = np.concatenate([t.bucket, t.pair_bucket])
    weight = np.concatenate([times / max(1, times.sum()), np.full(len(t.pair_bucket), 1 / max(1, t.pairs[0]))])
    there, at = np.unique(bucket, return_inverse=True)
    return there.astype(np.int32), np.bincount(at, weight, minlength=len(there)).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, p: Subwords) -> Model:
    """Stochastic gradient descent, a text at a time, with a linearly falling rate; classes weigh alike."""
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1, 1, (p.buckets + p.pair_buckets, p.width)).astype(np.float32) / p.width
    output, bias = np.zeros((2, p.width), np.float32), np.zeros(2, np.float32)
    features = [_text_features(t, p) for t in texts]
    weight = len(labels) / (2 * np.maximum(np.bincount(labels, minlength=2), 1))
    weight = np.sqrt(weight)
    steps, done = p.epochs * len(texts), 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(texts)):
            bucket, share = features[i]
            hidden = share @ vectors[bucket]
            z = output @ hidden + bias
            e = np.exp(z - z.max())
            error = (e / e.sum()).astype(np.float32)
            error[labels[i]] -= 1
            error *= (1 - done / steps) * weight[labels[i]]
            back = error @ output
            output -= p.rate * np.outer(error, hidden)
            bias -= 0.1 * p.rate * error
            vectors[bucket] -= p.vector_rate * share[:, None] * back
            done += 1
    return Model(vectors, output, bias)


def fit(labelled: DataFrame, p: Subwords = Subwords()) -> Model:
    """labelled(doc_id, text, label): the model of at most p.max_training_texts of its rows.

    Rows with a null label or one other than 0 and 1 teach nothing; a null text is empty. Without labelled
    rows every text scores 0.5. Which rows are taken depends on ids alone (then labels and texts for ties).
    """
    sample = labelled.where("label in (0, 1)").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.xxhash64("text")).limit(p.max_training_texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            labels += b.column("label").to_pylist()
        model = train(texts, np.array(labels, dtype=np.int64), p)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = sample.select("text", "label").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else Model(np.zeros((p.buckets + p.pair_buckets, p.width), np.float32), np.zeros((2, p.width), np.float32), np.zeros(2, np.float32))


def score(docs: DataFrame, model: Model, p: Subwords = Subwords(), keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs(text, ...): the columns keep, then two with the given names: score double (the chance of label 1) and predicted int, for every row.

    Null and empty texts get the score of the bias alone. Repeated rows stay; other columns are ignored.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)  # buckets * width floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                m = spread.value
                z = averages(part.column("text"), m.vectors, p) @ m.output.T + m.bias
                chance = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -60, 60)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(chance), pa.array((chance >= 0.5).astype(np.int32))], [*keep, *names])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"{names[0]} double", f"{names[1]} int"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def with_labels(docs: DataFrame, labels: DataFrame, label: str, p: Subwords = Subwords()) -> DataFrame:
    """(doc_id, text, label) of the sample that fit() takes, chosen from the small label table before texts are read."""
    chosen = labels.where(f"{label} in (0, 1) and doc_id is not null").select("doc_id", F.col(label).alias("label")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(p.max_training_texts)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
