"""Streaming folds: caches that see one access at a time, traces that come layer by layer, windows counted in tokens.

A stream is split by a shard column; within a shard, rows of a trigger are taken in the order of i, and state goes from
trigger to trigger. Rows that come in a later trigger than their successors are taken when they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bytecache import POLICIES, Sketch

COUNTS = "shard long, lookups long, hits long, bytes_read long, evictions long"


def cache(accesses: DataFrame, policy: str, capacity: int) -> DataFrame:
    """shard, lookups, hits, bytes_read, evictions so far, for a stream (shard, i, key, size); every policy but Belady's,
    which would have to know what comes. Output mode: update."""
    if policy == "belady":
        raise ValueError("belady needs the whole log")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n, hits, read = cloudpickle.loads(state.get[0]) if state.exists else (POLICIES[policy](capacity, []), 0, 0, 0)  # noqa: S301
        rows = pd.concat(list(batches)).sort_values("i")
        for i, k, size in zip(rows["i"], rows["key"], rows["size"], strict=True):
            n += 1
            if held.access(int(i), int(k), int(size)):
                hits += 1
            else:
                read += int(size)
        state.update((cloudpickle.dumps((held, n, hits, read)),))
        yield pd.DataFrame({"shard": [key[0]], "lookups": [n], "hits": [hits], "bytes_read": [read], "evictions": [held.evicted]})

    at = accesses.select(F.col("shard").cast("long").alias("shard"), "i", "key", "size").groupBy("shard")
    return at.applyInPandasWithState(fold, COUNTS, "held binary", "update", GroupStateTimeout.NoTimeout)


def frequencies(accesses: DataFrame, entries: int) -> DataFrame:
    """shard, key, estimate of the keys of each trigger, from a sketch whose counts are halved as it ages."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sketch = cloudpickle.loads(state.get[0]) if state.exists else Sketch()  # noqa: S301
        sketch.limit = 10 * entries
        rows = pd.concat(list(batches)).sort_values("i")
        for k in rows["key"]:
            sketch.add(int(k))
        state.update((cloudpickle.dumps(sketch),))
        own = sorted({int(k) for k in rows["key"]})
        yield pd.DataFrame({"shard": key[0], "key": own, "estimate": [sketch.count(k) for k in own]})

    at = accesses.select(F.col("shard").cast("long").alias("shard"), "i", "key").groupBy("shard")
    return at.applyInPandasWithState(fold, "shard long, key long, estimate int", "sketch binary", "update", GroupStateTimeout.NoTimeout)


def complete_tokens(choices: DataFrame, layers: int) -> DataFrame:
    """token, layer, experts of a stream (token, layer, experts), given out once all layers of a token have come; a layer
    that comes twice counts once, the later one. State of a token goes when the token does. Output mode: append."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = cloudpickle.loads(state.get[0]) if state.exists else {}  # noqa: S301
        for b in batches:
            for layer, own in zip(b["layer"], b["experts"], strict=True):
                held[int(layer)] = [int(e) for e in own]
        if len(held) < layers:
            state.update((cloudpickle.dumps(held),))
            return
        state.remove()
        yield pd.DataFrame({"token": key[0], "layer": sorted(held), "experts": [held[la] for la in sorted(held)]})

    at = choices.select("token", "layer", "experts").groupBy("token")
    return at.applyInPandasWithState(fold, "token long, layer int, experts array<int>", "held binary", "append", GroupStateTimeout.NoTimeout)


def count_windows(tokens: DataFrame, window: int) -> DataFrame:
    """shard, domain, win, rows of a stream (shard, i, marks): each window of so many tokens within a subject once it is full.
    marks: whether a token starts a subject; what is left of the subject before it is dropped. Output mode: append."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        domain, win, n = state.get if state.exists else (0, 0, 0)
        out = []
        for mark in pd.concat(list(batches)).sort_values("i")["marks"]:
            if mark:
                domain, win, n = domain + 1, 0, 0
            n += 1
            if n == window:
                out.append((key[0], domain, win, n))
                win, n = win + 1, 0
        state.update((domain, win, n))
        yield pd.DataFrame(out, columns=["shard", "domain", "win", "rows"])

    at = tokens.select(F.col("shard").cast("long").alias("shard"), "i", "marks").groupBy("shard")
    return at.applyInPandasWithState(fold, "shard long, domain long, win long, rows long", "domain long, win long, n long", "append", GroupStateTimeout.NoTimeout)


def workload(spark: SparkSession, rows_per_second: int, hot: int = 16, noise: int = 4, shards: int = 4, size: int = 4096) -> DataFrame:
    """A stream (shard, i, key, size): of hot + noise accesses, `hot` go to a set of as many keys, the others to new ones."""
    at = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    turn = F.pmod(F.floor(F.col("value") / shards), F.lit(hot + noise))
    key = F.when(turn < hot, F.pmod(F.xxhash64("value"), F.lit(hot))).otherwise(F.col("value") + 1000)
    return at.select(F.pmod("value", F.lit(shards)).alias("shard"), F.col("value").alias("i"), key.cast("long").alias("key"), F.lit(size).cast("long").alias("size"))
