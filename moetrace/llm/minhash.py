"""Near-duplicate documents by HyperMinHash.

A document's distinct word shingles are hashed to 64 bits; each of k hash functions keeps its minimum as a register of
a leading-zero count and mantissa bits. Registers are banded into bucket keys, candidate pairs are estimated from the
compressed registers with the expected register collisions taken off, and what the estimate leaves is verified on the
full shingle sets. Documents with equal sets (of 64-bit shingle hashes) form one class before any of that, so exact
copies never meet in pairs. Three steps lose a link by chance: bands 1.6e-5 at exactly 0.8 (far less above), the estimate
2e-9, and the registers' last bits 4e-11.

Defined results: a null or wordless text has no shingles and links with nothing; a text with fewer words than a shingle
is one shingle; rows that share a doc_id count as one document; a null doc_id is never a representative (its row gets
its class's component, or null where the class has no id); extra columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, among, release, settle, small_batches
from .graph import link_buckets

#: With a Jaccard of 0.8, a pair misses all of 28 bands of 5 with probability 1.6e-5.
BANDS, ROWS = 28, 5
#: Bits of mantissa in a register; leading zeros take the 6 bits above.
MANTISSA = 10
#: A pair goes to verification if its estimate is within this of the threshold: over five standard deviations of 140 registers.
SLACK = 0.2
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Words(dict):
    """64-bit hashes of words; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str) -> list[bytes]:
    """A-Z lower-cased; words are split at U+0020 and U+0009 to U+000D: what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    w = words(text or "")
    if not w:
        return set()
    return set(zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else {tuple(w)}


def shingle_hashes(text: str | None, size: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    w = words(text or "")
    if not w:
        return np.empty(0, U)
    h = np.fromiter(map(cache.__getitem__, w), U, len(w))
    n = max(1, len(w) - size + 1)
    out = np.full(n, U(min(size, len(w))))
    for i in range(min(size, len(w))):
        out = _mix(out * U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def _multipliers(k: int) -> np.ndarray:
    return _mix(np.arange(1, k + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def registers(h: np.ndarray, k: int) -> np.ndarray:
    """k registers: leading zeros of the minimum, then MANTISSA bits after its first one."""
    a, low = _multipliers(k), np.full(k, U(2**64 - 1))
    for i in range(0, len(h), 2048):
        np.minimum(low, (h[i : i + 2048, None] * a).min(axis=0), out=low)
    zeros = np.minimum(64 - np.frexp(low.astype(np.float64))[1], 62).astype(U)
    return (zeros << U(MANTISSA) | (low << (zeros + U(1))) >> U(64 - MANTISSA)).astype(np.uint16)


def bits(reg: np.ndarray) -> list[int]:
    """The last bit of each of the first 128 registers, as two longs: registers that agree give equal bits, others by chance."""
    return np.packbits(reg[:128].astype(np.uint8) & 1).view(np.int64).tolist()


#: Slots that shingles are counted in to tell rare ones, and documents counted at most.
SLOTS, RARE_ROWS = 1 << 20, 2000
#: Longs of an odd sketch.
ODD = 16


def odd_sketch(h: np.ndarray) -> list[int]:
    """For each of 64 * ODD slots, whether an odd number of hashes falls there. Where two sketches differ in d bits, the
    sets differ in d elements at least: a bound that never turns a link away."""
    slots = np.bincount((h % U(64 * ODD)).astype(np.int64), minlength=64 * ODD)
    return np.packbits(slots.astype(np.uint8) & 1).view(np.int64).tolist()


def most_unlike(percent: int) -> int:
    """Of 128 such bits, as many as may differ between sets of that Jaccard: the mean and 6.5 standard deviations."""
    p = (1 - percent / 100) / 2
    return int(128 * p + 6.5 * (128 * p * (1 - p)) ** 0.5)


def band_keys(reg: np.ndarray, bands: int, rows: int) -> np.ndarray:
    at = reg.astype(U).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=U)
    for i in range(rows):
        key = _mix(key * U(0x9E3779B97F4A7C15) + at[:, i] + U(1))
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers; n, m: set sizes.

    Two unrelated minima agree in leading zeros and mantissa with probability nm / (n+m)^2 / (2^MANTISSA * 2 ln 2):
    a register value spans a share of 1 / (2^MANTISSA) of its octave, and minima are exponential about 1/n and 1/m."""
    agree = (a == b).mean(axis=1)
    by_chance = n * m / (n + m) ** 2 / (2**MANTISSA * 2 * np.log(2))
    return np.clip((agree - by_chance) / (1 - by_chance), 0, 1)


def signatures(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_hash (16 bytes over the whole set), registers, bits (the registers' last bits, then the odd sketch), keys."""
    small_batches(docs.sparkSession)

    kinds = {"n_shingles": pa.int64(), "set_hash": pa.binary(), "registers": pa.binary(), "bits": pa.list_(pa.int64()), "keys": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for x in batches:
            out = []
            for text in x["text"]:
                h = shingle_hashes(text.as_py(), size, cache)
                if len(h):
                    reg = registers(h, bands * rows)
                    out.append((len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), reg.tobytes(), bits(reg) + odd_sketch(h), band_keys(reg, bands, rows)))
                else:
                    out.append((0, None, None, None, None))
            # doc_id goes past as it came: pandas would make doubles of longs beside a null.
            made = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([x["doc_id"], *made], names=["doc_id", *kinds])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, registers binary, bits array<long>, keys array<long>")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for documents (doc_id, text): one row per row of docs."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    sig = settle(signatures(docs, size, bands, rows))
    classes = settle(sig.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"), F.first("bits").alias("bits"), F.first("keys").alias("keys")))
    named = classes.where("id is not null")

    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (a, b))
        return pd.Series(estimate(x, y, n.to_numpy(float), m.to_numpy(float)) >= percent / 100 - SLACK)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, sa = [], None, set()
        for s, t in zip(a, b, strict=True):
            if s != last:
                last, sa = s, shingle_set(s, size)
            sb = shingle_set(t, size)
            both = len(sa & sb)
            out.append(100 * both >= percent * (len(sa) + len(sb) - both))
        return pd.Series(out, dtype=bool)

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs)
        ids = settle(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        held = settle(among(named.select("id", "n", "registers"), ids, "id"))
        for side in "ab":
            pairs = pairs.join(held.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("registers").alias(f"r{side}")), side)
        bound = f"least(na, nb) * 100 >= {percent} * greatest(na, nb)"
        close = settle(pairs.where(bound).where(likely("ra", "rb", "na", "nb")).select("a", "b"))
        release(held)
        ids = settle(close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        texts = settle(among(docs, ids, "doc_id"))
        for side in "ab":
            close = close.join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"t{side}")), side)
        return close.where(alike("ta", "tb")).select("a", "b").distinct()

    def prefixes(ids: DataFrame) -> DataFrame:
        """The rarest shingles of each document, as many as a link must share one of. How rare they are is counted in
        a bounded sample; any order that all documents keep gives the same links."""
        texts = settle(among(docs, ids.select(F.col("id").alias("doc_id")), "doc_id"))
        n = max(1, texts.count())

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cache, slots = _Words(), np.zeros(SLOTS, np.int64)
            for x in batches:
                for text in x["text"]:
                    slots[(shingle_hashes(text, size, cache) >> U(8)).astype(np.int64) % SLOTS] += 1
            yield pd.DataFrame({"slot": (at := np.flatnonzero(slots)), "n": slots[at]})

        some = texts.where(F.pmod(F.xxhash64(F.lit("rare"), "doc_id"), F.lit(1_000_000)) < F.lit(min(1.0, RARE_ROWS / n) * 1_000_000))
        seen = np.zeros(SLOTS, np.int32)
        for slot, k in some.mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.sum("n")).toPandas().to_numpy():
            seen[slot] = k
        held = Shared(spark, seen)

        def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cache = _Words()
            for x in batches:
                out = []
                for text in x["text"]:
                    h = shingle_hashes(text, size, cache)
                    h = h[np.lexsort((h, held.value[(h >> U(8)).astype(np.int64) % SLOTS]))]
                    out.append(h[: len(h) - -(-percent * len(h) // 100) + 1].view(np.int64))
                yield pd.DataFrame({"id": x["doc_id"], "first": out})

        return texts.mapInPandas(take, "id long, first array<long>").select("id", F.explode("first").alias("shingle")).distinct()

    def info(ids: DataFrame) -> DataFrame:
        return among(named.select("id", "n", F.col("bits").alias("b")), ids, "id")

    unlike = lambda low, high: " + ".join(f"bit_count(x_b[{i}] ^ y_b[{i}])" for i in range(low, high))
    near = f"least(x_n, y_n) * 100 >= {percent} * greatest(x_n, y_n) and {unlike(0, 2)} <= {most_unlike(percent)}"
    # Sets of that Jaccard differ in at most (100 - percent) / (100 + percent) of the sum of their sizes.
    near += f" and {100 + percent} * ({unlike(2, 2 + ODD)}) <= {100 - percent} * (x_n + y_n)"
    found = link_buckets(named.select(F.explode(F.array_distinct("keys")).alias("key"), "id", "copies"), verify, info, near, prefixes)
    where = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("set_hash", F.coalesce("component", "id").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "set_hash").join(where, "set_hash", "left")
    out = out.withColumn("component_id", F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))
