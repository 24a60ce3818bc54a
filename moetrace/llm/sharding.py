"""Uniform shuffles into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in blocks (by a hash of the row). How many rows each block sends to each shard is drawn from the multivariate
hypergeometric law, given the blocks' sizes and the shards' exact sizes; that is how a uniform permutation would deal
them. Each block is permuted locally and cut by its row of the matrix, the parts are exchanged, and each shard is
permuted again. Everything is fixed by the seed and the rows, so a lost executor's part comes out the same again.

Defined results: sizes of shards differ by one at most, the first N mod S ones being larger; null texts have size 8 and
the checksum of the empty text; rows equal in all of doc_id and text are interchangeable; empty tables have no rows; write_shards replaces columns size, text_crc32, shard and slot."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import blocks, number_rows, settle, without


def draw(rng: np.random.Generator, good: int, total: int, n: int) -> int:
    """How many of n rows drawn from total are among the good ones: exact to double precision at any size."""
    low, high = max(0, n + good - total), min(n, good)
    if low >= high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    wide = 24 + int(12 * math.sqrt(n * (good / total) * (1 - good / total) * (total - n) / max(1, total - 1)))
    low, high = max(low, mode - wide), min(high, mode + wide)
    k = np.arange(low, high, dtype=float)
    ratio = (np.log(good - k) + np.log(n - k)) - (np.log(k + 1) + np.log(total - good - n + k + 1))
    log = np.concatenate(([0.0], np.cumsum(ratio)))
    p = np.exp(log - log.max())
    return low + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), "right"))


def matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Rows of each block that go to each shard: row sums are the blocks' sizes, column sums the shards'."""
    rng, left = np.random.default_rng(seed), list(shard_sizes)
    out = np.zeros((len(block_sizes), len(shard_sizes)), np.int64)
    for i, n in enumerate(block_sizes):
        rest = sum(left)
        for j, own in enumerate(left):
            k = draw(rng, own, rest, n) if n else 0
            out[i, j], left[j] = k, own - k
            n, rest = n - k, rest - own
    return out


def assign(rows: DataFrame, n_shards: int, key: list[str], seed: int = 11) -> DataFrame:
    """rows with shard and slot (from 0 without gaps in each shard); key: columns that tell rows apart."""
    spark = rows.sparkSession
    n_blocks = blocks(spark)
    at = rows.withColumn("_at", F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), *key), F.lit(n_blocks)))
    sizes = {r["_at"]: r["count"] for r in at.groupBy("_at").count().collect()}  # n_blocks rows
    sizes = [sizes.get(i, 0) for i in range(n_blocks)]
    total = sum(sizes)
    dealt = matrix(sizes, [total // n_shards + (i < total % n_shards) for i in range(n_shards)], seed)
    kind = T.StructType([T.StructField("_at", T.LongType()), T.StructField("_cuts", T.ArrayType(T.LongType()))])
    cuts = spark.createDataFrame([(i, [int(x) for x in c]) for i, c in enumerate(dealt.cumsum(axis=1))], kind)
    local = Window.partitionBy("_at").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), *key), *key)
    at = at.withColumn("_r", F.row_number().over(local) - 1).join(F.broadcast(cuts), "_at")  # n_blocks x n_shards numbers
    at = at.withColumn("shard", F.expr("cast(size(filter(_cuts, x -> x <= _r)) as int)")).drop("_at", "_r", "_cuts")
    return number_rows(at.withColumn("_seed", F.lit(seed)), ["shard"], ["_seed", *key], "slot", n_blocks).drop("_seed")


def digest(text: Column) -> tuple[Column, Column]:
    """Size (bytes plus 8) and unsigned CRC-32 of a text."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    return (F.octet_length(raw) + 8).cast("long"), F.crc32(raw)


def shard_documents(docs: DataFrame, n_shards: int = 24, seed: int = 11) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: only these narrow rows are shuffled."""
    size, crc = digest(F.col("text"))
    narrow = settle(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.xxhash64("text").alias("_text")))
    return assign(narrow, n_shards, ["doc_id", "size", "text_crc32", "_text"], seed).drop("_text")


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, seed: int = 11) -> None:
    """Write the documents as Parquet under path, a folder per shard, with their slots; files are sorted by slot."""
    size, crc = digest(F.col("text"))
    docs = without(docs, "size", "text_crc32", "shard", "slot")
    placed = assign(docs.withColumns({"size": size, "text_crc32": crc, "_text": F.xxhash64("text")}), n_shards, ["doc_id", "size", "text_crc32", "_text"], seed)
    placed.drop("_text").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
