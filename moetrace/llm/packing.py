"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are tokenised; longer ones are cut into whole sequences and a shorter first piece. Over the histogram of piece
lengths (as many rows as a sequence has tokens, whatever the input) a configuration linear program is solved by
multiplicative weights: the pricing problem, the most valuable filling of one sequence, is an unbounded knapsack solved
by dynamic programming. Rounds end when every length is covered; the weights also prove a lower bound. The fractional
solution is rounded down, what is left goes by best fit decreasing, and the result is kept if it takes no more sequences
than best fit alone; solve reports the bound, and what share of the pieces the programme placed. Pieces find their places by their rank among the
pieces of their length.

Defined results: a null text counts as empty; an empty text is one piece of the separator alone; rows that share a
doc_id are packed each on their own; an empty table gives no pieces."""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Shared, blocks, number_rows, settle, small_batches

CAPACITY = 2048
#: Rounds of multiplicative weights at most, the share of a length's pieces that a round may cover, and how fast covered lengths lose weight.
ROUNDS, RATE, SLOPE = 1500, 0.25, 4.0
SEPARATOR = b"\0\0\0\0"
# Fixed value: how the byte-level vocabulary's tokenizer splits a text before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"


class _Ids:
    """Ids of texts as little-endian 32-bit bytes. The vocabulary's merges run in the faster of the two libraries that
    read it; texts that spell a special token go to the tokenizer itself. Tests hold the ids of both equal."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        plain = {chr(c): c for c in (*range(33, 127), *range(161, 173), *range(174, 256))}
        rest = [b for b in range(256) if b not in plain.values()]
        plain |= {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(plain[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token != SPECIAL}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; tokenizer: the vocabulary file's path, the same on every executor."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sys.__dict__.setdefault("_moetrace_ids", {})  # by the Python worker, from task to task
        if tokenizer not in kept:
            kept[tokenizer] = _Ids(tokenizer)
        ids = kept[tokenizer].ids
        for x in batches:
            out = []
            for at, text in enumerate(x["text"]):
                raw = ids(text.as_py() or "") + SEPARATOR
                n = len(raw) // 4
                first = (n - 1) % capacity + 1
                starts = [0, *range(first, n, capacity)]
                for i, start in enumerate(starts):
                    end = first if not i else start + capacity
                    out.append((at, i, start, end - start, zlib.crc32(raw[4 * start : 4 * end])))
            # doc_id goes past as it came: pandas would make doubles of longs beside a null.
            of, piece, *rest = ([r[i] for r in out] for i in range(5))
            made = [x["doc_id"].take(pa.array(of, pa.int32())), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in rest]]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _best_filling(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How often each size stands in the most valuable filling of one sequence, and its value."""
    # A size no dearer than a smaller one is never taken.
    front = np.flatnonzero(value > np.concatenate(([0.0], np.maximum.accumulate(value)[:-1])))
    own, worth = sizes[front], value[front]
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(own, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            gain = best[c - own[:k]] + worth[:k]
            if gain[i := int(gain.argmax())] > best[c] + 1e-15:
                best[c], choice[c] = gain[i], i
    out, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            out[front[choice[c]]] += 1
            c -= own[choice[c]]
    return out, float(best[capacity])


Groups = list[tuple[dict[int, int], int]]


def best_fit(counts: dict[int, int], capacity: int) -> Groups:
    """Best fit decreasing over a histogram: (pieces of each length in a sequence, number of such sequences)."""
    room: dict[int, list[tuple[dict[int, int], int]]] = {capacity: []}

    def put(held: dict[int, int], left: int, size: int, k: int, times: int) -> None:
        if times:
            room.setdefault(left - k * size, []).append(({**held, size: held.get(size, 0) + k}, times))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        for left in sorted(r for r in room if r >= size):
            here, room[left] = room[left], []
            k = left // size
            for held, times in here:
                full = min(times, n // k)
                put(held, left, size, k, full)
                n -= full * k
                rest = times - full
                if rest and n and n < k:
                    put(held, left, size, n, 1)
                    n, rest = 0, rest - 1
                if rest:
                    room[left].append((held, rest))
        k = capacity // size
        put({}, capacity, size, k, n // k)
        if n % k:
            put({}, capacity, size, n % k, 1)
    return [x for at in room.values() for x in at]


class Solved:
    """A solution of the configuration programme: fillings with how often each is used (fractions), and the bound that the
    best weights met on the way prove: no packing takes fewer sequences."""

    def __init__(self, counts: dict[int, int], capacity: int, rounds: int = ROUNDS):
        self.sizes = np.array(sorted(counts))
        self.need = np.array([counts[s] for s in self.sizes], float)
        self.bound, self.rounds, self.used = float(self.need @ self.sizes) / capacity, 0, {}
        covered, weight = np.zeros(len(self.sizes)), self.sizes / capacity
        while self.rounds < rounds and len(self.sizes) and covered.min() < 1:
            fill, worth = _best_filling(weight, self.sizes, capacity)
            self.bound = max(self.bound, float(self.need @ weight) / worth)
            at = np.flatnonzero(fill)
            step = RATE * (self.need[at] / fill[at]).min()
            self.used[tuple(fill)] = self.used.get(tuple(fill), 0.0) + step
            covered[at] += step * fill[at] / self.need[at]
            # Lengths that are covered lose weight, so that the others enter the fillings.
            weight = self.sizes / capacity * np.exp(-SLOPE * np.maximum(0, covered - covered.min()))
            self.rounds += 1
        self.covered = covered

    @property
    def value(self) -> float:
        """Sequences of the fractional solution, scaled so that every length is covered; infinite before that is so."""
        least = self.covered.min() if len(self.covered) else 1.0
        return sum(self.used.values()) / least if least > 0 else float("inf")


def plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Groups:
    """Fillings and how often each is used; every piece of the histogram is placed once."""
    return solve(counts, capacity, rounds)[0]


def solve(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[Groups, dict[str, float]]:
    """The plan, and a report of it: sequences, the programme's bound and value, its rounds, the share of pieces that its
    rounded fillings place (0 where plain best fit took fewer sequences and was kept), and what best fit alone takes."""
    counts = {k: n for k, n in counts.items() if n}
    plain = best_fit(counts, capacity)
    if not counts:
        return plain, {"sequences": 0, "bound": 0.0, "value": 0.0, "rounds": 0, "share": 0.0, "best_fit": 0}
    solved = Solved(counts, capacity, rounds)
    sizes, left, out = solved.sizes, solved.need.astype(np.int64), []
    scale = 1 / max(1.0, solved.covered.max())
    # Rounded down, fullest fillings first, never beyond what is left; then whole copies of fillings that still fit.
    order = sorted(solved.used.items(), key=lambda x: -(np.array(x[0]) @ sizes))
    for whole in (False, True):
        for f, x in order:
            f = np.array(f)
            at = np.flatnonzero(f)
            times = int((left[at] // f[at]).min())
            times = times if whole else min(times, int(x * scale))
            if times > 0 and (not whole or f @ sizes == capacity):
                left[at] -= times * f[at]
                out.append(({int(sizes[i]): int(f[i]) for i in at}, times))
    placed = 1 - left.sum() / solved.need.sum()
    out += best_fit({int(s): int(n) for s, n in zip(sizes, left, strict=True) if n}, capacity)
    number = lambda groups: sum(times for _, times in groups)
    mine = number(out) <= number(plain)
    groups = out if mine else plain
    return groups, {"sequences": number(groups), "bound": solved.bound, "value": solved.value, "rounds": solved.rounds, "share": float(placed) if mine else 0.0, "best_fit": number(plain)}


class Places:
    """Where the piece of some length and rank goes."""

    def __init__(self, groups: Groups):
        rows, used, base = [], {}, 0
        for held, times in groups:
            offset = 0
            for size in sorted(held, reverse=True):
                start = used.get(size, 0)
                rows.append((size, start, base, held[size], offset))
                used[size] = start + held[size] * times
                offset += size * held[size]
            base += times
        self.at = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.keys, self.sequences = self.at[:, 0] << 44 | self.at[:, 1], base

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.at[np.searchsorted(self.keys, size << 44 | rank, "right") - 1]
        return r[:, 2] + (rank - r[:, 1]) // r[:, 3], r[:, 4] + (rank - r[:, 1]) % r[:, 3] * size


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of docs (doc_id, text) with sequence_id and offset."""
    spark = docs.sparkSession
    at = settle(pieces(docs, tokenizer, capacity))
    counts = {r["length"]: r["count"] for r in at.groupBy("length").count().collect()}  # at most capacity rows
    held = Shared(spark, Places(plan(counts, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s, o = held.value.find(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": s, "offset": o})

    ranked = number_rows(at, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_rank_of", blocks(spark))
    return ranked.withColumn("_place", place("length", "_rank_of")).select(*at.columns, "_place.*")
