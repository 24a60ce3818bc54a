"""Benchmark decontamination by the q-gram lemma.

Texts and items are lower-cased and their white space is folded. An item of m characters occurs in a text with at most
e = floor(rate * m) edits only if one region of it shares at least m - q + 1 - q * e of the item's q-grams, on diagonals
at most e apart. So shared q-grams are counted in overlapping diagonal bands, bands that reach that bound are kept, and
an alignment within the band verifies the edit distance. Items for which that bound is not positive are searched with
shorter q-grams, down to SHORT; only items shorter than SHORT (their budget is no edit) are searched as substrings.

What is sought is the whole item within its budget: a text that quotes part of an item, or with more of it changed, is
clean.

Defined results: null and empty texts are clean; null and empty items are skipped; repeated item ids are all searched; a
column items is replaced; texts of any length are searched in overlapping pieces. A benchmark of any size is taken in
blocks, each searched against all rows, and what a block found is written before the next one's index is made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, settle, small_batches

Q, SHORT, RATE = 10, 6, 0.08
#: Characters of benchmark items that a pass over the texts looks for.
BLOCK_CHARS = 4_000_000
#: Bits of the bitmap that most q-grams are turned away by.
BITS = 24
#: Characters of a text looked at together; pieces overlap by more than the longest region.
PIECE = 1 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(x: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of the q-grams, built by doubling their length."""
    if len(x) < q:
        return np.empty(0, np.uint64)
    n, out, done = 1, None, 0
    level, base = x.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15
    left = q
    while left:
        if left & 1:
            out = level.copy() if out is None else out[: len(level) - done] * np.uint64(base) + level[done:]
            done += n
        left >>= 1
        if left:
            level = level[:-n] * np.uint64(base) + level[n:]
            level ^= level >> np.uint64(29)
            n, base = 2 * n, (base * base + 2) % 2**64 | 1
    return out[: len(x) - q + 1]


def edits_within(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> bool:
    """Whether the item is within `most` edits of a substring of the text, aligned on diagonals low to high only (place
    in the text less place in the item): one row of the band for each character of the item."""
    wide, far = high - low + 1, most + 1
    at = np.arange(low, high + 1)
    k = np.arange(wide)
    padded = np.concatenate((np.full(max(0, -low), 0xFFFFFFFF, np.uint32), text, np.full(max(0, high + len(item) - len(text)), 0xFFFFFFFF, np.uint32)))
    shift = max(0, -low)
    row = np.where((at >= 0) & (at <= len(text)), 0, far)
    for i, c in enumerate(item):
        start = i + low + shift
        best = row + (padded[start : start + wide] != c)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        # Places before the text's start are no places, except where all of the item so far is left out.
        place = at + i + 1
        best = np.where((place < 0) | (place > len(text)), far, best)
        row = np.minimum(np.minimum.accumulate(best - k) + k, far)
        if row.min() > most:
            return False
    return True


class Grams:
    """The q-grams of some items, with their places."""

    def __init__(self, q: int, items: list[tuple[int, str]], rate: float):
        self.q, self.items, places = q, [], []
        for item_id, text in items:
            x, e = codes(text), int(rate * len(text))
            g = gram_hashes(x, q)
            places.append(np.c_[g.view(np.int64), np.full(len(g), len(self.items)), np.arange(len(g))])
            self.items.append((item_id, text, x, e, len(x) - q + 1 - q * e))
        at = np.concatenate(places)
        at = at[np.argsort(at[:, 0].view(np.uint64), kind="stable")]
        self.grams, self.first, self.n = np.unique(at[:, 0].view(np.uint64), return_index=True, return_counts=True)
        self.item, self.place = at[:, 1], at[:, 2]
        self.map = np.zeros(1 << BITS, bool)
        self.map[(self.grams >> np.uint64(64 - BITS)).astype(np.int64)] = True
        self.width = max(e for *_, e, _ in self.items) + 1
        self.need = np.array([x[4] for x in self.items], np.int64)
        self.longest = max(len(x[2]) for x in self.items)

    def find(self, text: str) -> set[int]:
        step = self.longest + 4 * self.width
        found: set[int] = set()
        for i in range(0, max(1, len(text)), PIECE):
            found |= self._piece(text[i : i + PIECE + step])
        return found

    def _piece(self, text: str) -> set[int]:
        if len(text) < self.q:
            return set()
        x = codes(text)
        h = gram_hashes(x, self.q)
        at = np.flatnonzero(self.map[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        h = h[at]
        k = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
        real = self.grams[k] == h
        at, k = at[real], k[real]
        if not len(at):
            return set()
        n = self.n[k]
        each = np.repeat(self.first[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item, diagonal = self.item[each], np.repeat(at, n) - self.place[each]
        band = diagonal // self.width
        low = int(band.min()) - 1
        span = int(band.max()) - low + 2
        keys, counts = np.unique(np.concatenate((item * span + band - low, item * span + band - low - 1)), return_counts=True)
        good = counts >= self.need[keys // span]
        found: set[int] = set()
        for key in keys[good]:
            item_id, own, y, e, _ = self.items[key // span]
            if item_id in found:
                continue
            start = (int(key % span) + low) * self.width
            if own in text[max(0, start) : max(0, start + 2 * self.width + len(y))] or edits_within(y, x, start - e, start + 2 * self.width + e, e):
                found.add(item_id)
        return found


class Index:
    """A block of benchmark items: by q-grams of Q characters where the lemma allows it, of SHORT ones, or as they are."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE):
        kinds: dict[int, list[tuple[int, str]]] = {q: [], SHORT: [], 0: []}
        for item_id, text in items:
            kinds[next((g for g in (q, SHORT) if len(text) - g + 1 - g * int(rate * len(text)) > 0), 0)].append((item_id, text))
        self.exact = kinds.pop(0)
        self.grams = [Grams(g, own, rate) for g, own in kinds.items() if own]

    def find(self, text: str | None) -> list[int]:
        text = normal(text)
        found = {i for i, t in self.exact if t in text}
        for g in self.grams:
            found |= g.find(text)
        return sorted(found)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        if text := normal(r["text"]):
            block.append((r["item_id"], text))
            size += len(text)
            if size >= BLOCK_CHARS:
                yield block
                block, size = [], 0
    if block:
        yield block


def find_items(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """docs with items: the sorted ids of the benchmark items found in the text."""
    spark = docs.sparkSession
    small_batches(spark)
    out, held = docs.withColumn("items", F.expr("cast(array() as array<bigint>)")), None
    for block in _blocks(benchmark):
        if held is not None:  # one index in memory at a time
            out = settle(out)
            held.unpersist()
        held = Shared(spark, Index(block, q, rate))
        out = out.withColumn("items", F.array_sort(F.array_union("items", _finder(held)("text"))))
    return out


def _finder(held: Shared):  # noqa: ANN202
    """A UDF that searches texts for the items of a block, which has at most about BLOCK_CHARS characters."""

    @F.pandas_udf("array<bigint>")
    def find(text: pd.Series) -> pd.Series:
        return pd.Series([held.value.find(t) for t in text], dtype=object)

    return find
