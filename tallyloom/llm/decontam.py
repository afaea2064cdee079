"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased (A-Z) and runs of white space become one space. An item with an error budget
of e edits is cut into e + 1 pieces, of which any occurrence within e edits holds at least one unchanged. One
automaton per block of items finds all pieces in a text at once; around each hit, Myers' bit-parallel
distance is computed over the window in which an occurrence can lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EditMatch:
    """error_percent: edits allowed, in hundredths of an item's length; block_chars: items are taken in blocks
    of about this many characters, so an automaton's size is bounded whatever the benchmark's."""

    error_percent: int = 5
    block_chars: int = 2_000_000


_SPACE = re.compile(r"[ \t\n\v\f\r]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def normal(text: str | None) -> str:
    return _SPACE.sub(" ", (text or "").translate(_LOWER)).strip(" ")


def budget(item: str, p: EditMatch) -> int:
    return len(item) * p.error_percent // 100


def cut(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their places."""
    bounds = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def myers(item: str, text: str) -> tuple[int, int]:
    """(least distance of item to a part of text, the end of the first such part), bit-parallel over the item."""
    m = len(item)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, score = mask, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(xh | plus) & mask
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & mask  # a match may begin anywhere in the text: no carry in
        down = down << 1 & mask
        plus = down | ~(xv | up) & mask
        minus = up & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Finds the items of one block: {item_id: normal text}."""

    def __init__(self, items: list[tuple[int, str]], p: EditMatch):
        self.items = [(i, t, budget(t, p)) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for at, piece in cut(text, errors):
                pieces.setdefault(piece, []).append((n, at))
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) of each item that the text holds, at its first least distance.

        start is the end minus the item's length, an estimate where edits changed the length.
        """
        best: dict[int, tuple[int, int]] = {}
        seen: set[tuple[int, int]] = set()
        for last, (size, owners) in self.automaton.iter(text):
            for n, at in owners:
                _, item, errors = self.items[n]
                origin = last - size + 1 - at
                if best.get(n, (errors + 1,))[0] == 0 or (n, origin) in seen:
                    continue
                seen.add((n, origin))
                if text.startswith(item, origin) and origin >= 0:
                    best[n] = (0, origin + len(item))
                    continue
                a = max(0, origin - errors)
                distance, end = myers(item, text[a : origin + len(item) + errors])
                if distance <= errors and distance < best.get(n, (errors + 1,))[0]:
                    best[n] = (distance, a + end)
        return [(self.items[n][0], max(0, end - len(self.items[n][1])), end, d) for n, (d, end) in sorted(best.items())]


def _blocks(benchmark: DataFrame, p: EditMatch) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in benchmark.select("item_id", "text").where("item_id is not null").toLocalIterator():
        text = normal(row.text)
        if text:
            block.append((row.item_id, text))
            size += len(text)
        if size >= p.block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, p: EditMatch = EditMatch()) -> DataFrame:
    """(doc_id, item_id, start, end, distance): a row per document and item that it holds within the error budget.

    Places count in the normal form of the text. Null and empty texts and items match nothing; items of equal
    text match each; repeated rows give repeated results; columns other than doc_id, text and item_id, text are
    ignored. The benchmark is read in blocks, each with its own automaton and pass over the documents.
    """
    found = None
    for block in _blocks(benchmark, p):
        spread = docs.sparkSession.sparkContext.broadcast(sorted(block))

        def run(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(spread.value, p)
            for batch in batches:
                rows = []
                for i, text in enumerate(batch.column("text")):
                    rows += [(i, *hit) for hit in matcher.find(normal(text.as_py()))]
                at, *rest = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in rest)], names)

        names = ["doc_id", "item_id", "start", "end", "distance"]
        kind = docs.schema["doc_id"].dataType.simpleString()
        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, start long, end long, distance long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.select("doc_id", *(F.lit(None).cast("long").alias(c) for c in ("item_id", "start", "end", "distance"))).limit(0)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, p: EditMatch = EditMatch()) -> DataFrame:
    """docs without the documents that hold a benchmark item; a null doc_id stays."""
    held = matches(docs, benchmark, p).select(F.col("doc_id").alias("held_id")).distinct()
    return docs.join(held, F.col("doc_id") == F.col("held_id"), "left_anti")
