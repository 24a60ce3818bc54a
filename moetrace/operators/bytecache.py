"""Caches that hold entries of different sizes, as folds over one access log: a task for each (policy, capacity).

A fold depends on the order of its whole log, so one log is one task's work; logs and capacities run side by side. The
log reaches a fold in order, a packed stretch at a time, so a task holds what its cache holds and one stretch.
Every policy counts hits, misses, evictions and the bytes it had to read."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LATENCY_S, BANDWIDTH = 100e-6, 5.0e9
#: Counters saturate here; an entry counted HOT times may be held unpacked.
MOST, HOT = 15, 8
# One odd seed for each row of the sketch.
SEEDS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F)
WORD = (1 << 64) - 1


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & WORD
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & WORD
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & WORD
    return x ^ (x >> 31)


class Sketch:
    """Count-min sketch whose counters saturate and are halved after ten lookups for each entry the cache can hold."""

    def __init__(self, universe: int = 4096):
        self.width = 1 << (max(64, universe) - 1).bit_length()
        # One row after the other: single counters are reached faster here than in an array.
        self.rows = bytearray(len(SEEDS) * self.width)
        self.age, self.limit, self._at = 0, 10, {}

    def _cells(self, key: int) -> list[int]:
        if key not in self._at:
            self._at[key] = [i * self.width + (_splitmix(key ^ s) & (self.width - 1)) for i, s in enumerate(SEEDS)]
        return self._at[key]

    def add(self, key: int) -> None:
        rows, more = self.rows, False
        for c in self._cells(key):
            if rows[c] < MOST:
                rows[c] += 1
                more = True
        if more:
            self.age += 1
            if self.age >= self.limit:
                self.rows = bytearray(np.frombuffer(rows, np.uint8) >> 1)
                self.age //= 2

    def count(self, key: int) -> int:
        a, b, c, d = self._cells(key)
        rows = self.rows
        return min(rows[a], rows[b], rows[c], rows[d])


class Lru:
    def __init__(self, capacity: int, log: list[int]):
        self.capacity, self.held, self.used, self.evicted = capacity, OrderedDict(), 0, 0

    def access(self, i: int, key: int, size: int) -> bool:
        if key in self.held:
            self.held.move_to_end(key)
            return True
        if size <= self.capacity:
            while self.used + size > self.capacity:
                self.used -= self.held.popitem(last=False)[1]
                self.evicted += 1
            self.held[key] = size
            self.used += size
        return False


class Ranked:
    """Drops the held key of smallest rank; ranks may change, so superseded heap entries are passed over."""

    def __init__(self, capacity: int, log: list[int]):
        self.capacity, self.held, self.used, self.evicted = capacity, {}, 0, 0
        self.rank: dict[int, tuple] = {}
        self.heap: list[tuple] = []

    def put(self, key: int, rank: tuple) -> None:
        self.rank[key] = rank
        heapq.heappush(self.heap, (rank, key))
        # Superseded entries never outnumber the held keys for long: the heap grows with the cache, not with the log.
        if len(self.heap) > 2 * len(self.rank) + 64:
            self.heap = [(r, k) for k, r in self.rank.items()]
            heapq.heapify(self.heap)

    def lowest(self) -> int:
        while self.rank.get(self.heap[0][1]) != self.heap[0][0]:
            heapq.heappop(self.heap)
        return self.heap[0][1]

    def drop(self, key: int) -> None:
        del self.rank[key]
        self.used -= self.held.pop(key)
        self.evicted += 1

    def add(self, key: int, size: int, rank: tuple) -> None:
        self.held[key] = size
        self.used += size
        self.put(key, rank)


class Lfu(Ranked):
    """Counts every access; a newcomer counted less than the next to go stays out, though others may have gone before it."""

    def __init__(self, capacity: int, log: list[int]):
        super().__init__(capacity, log)
        self.n: Counter = Counter()

    def access(self, i: int, key: int, size: int) -> bool:
        self.n[key] += 1
        if key in self.held:
            self.put(key, (self.n[key], key))
            return True
        if size > self.capacity:
            return False
        while self.used + size > self.capacity:
            loser = self.lowest()
            if self.n[loser] > self.n[key]:
                return False
            self.drop(loser)
        self.add(key, size, (self.n[key], key))
        return False


class Belady(Ranked):
    """Drops the key whose next use is furthest, ties to the larger key: the best there is where all sizes are equal."""

    def __init__(self, capacity: int, log: list[int]):
        super().__init__(capacity, log)
        self.after, seen = [0] * len(log), {}
        for i in range(len(log) - 1, -1, -1):
            self.after[i] = seen.get(log[i], len(log) + 1)
            seen[log[i]] = i

    def access(self, i: int, key: int, size: int) -> bool:
        rank = (-self.after[i], -key)
        if key in self.held:
            self.put(key, rank)
            return True
        if size <= self.capacity:
            while self.used + size > self.capacity:
                self.drop(self.lowest())
            self.add(key, size, rank)
        return False


class Admitting:
    """A small window in order of use, and a main region ranked by frequency times reload cost over size.

    What falls out of the window enters the main region only if the sketch counts it above the entry it would displace
    (ties lose). Ranks age: the rank of the last entry dropped is the floor of new ones. Options: without that contest
    (admission=False), with a window that climbs towards the better hit rate (adaptive=True), or with entries of the main
    region held unpacked, in free space only, once the sketch counts HOT (unpacked: bytes by key)."""

    def __init__(self, capacity: int, log: list[int], admission: bool = True, adaptive: bool = False, window: float = 0.01, unpacked: dict[int, int] | None = None):
        self.unpacked, self.wide, self.promoted, self.bytes_in, self.bytes_out = unpacked or {}, {}, 0, 0, 0
        self.capacity, self.admission, self.adaptive = capacity, admission, adaptive
        self.least_window = self.budget = max(1, int(capacity * window))
        self.sketch, self.window, self.main = Sketch(), OrderedDict(), Ranked(capacity, log)
        self.in_window, self.floor, self.admitted, self.mean, self.lost = 0, 0.0, 0, 0.0, 0
        self.lookups = self.hits = self.last_lookups = self.last_hits = 0
        self.last_rate, self.grow = -1.0, True

    @property
    def evicted(self) -> int:
        return self.main.evicted + self.lost

    def _rank(self, key: int, size: int, held: int = 0) -> tuple:
        reload = LATENCY_S + size / BANDWIDTH
        return (self.floor + max(self.sketch.count(key), 1) * reload / max(held or size, 1), key)

    def _promote(self, key: int, size: int) -> None:
        more = self.unpacked.get(key, 0) - size
        if key in self.wide or more <= 0 or self.sketch.count(key) < HOT or self.in_window + self.main.used + more > self.capacity:
            return
        self.wide[key] = size
        self.main.held[key] = size + more
        self.main.used += more
        self.main.put(key, self._rank(key, size, size + more))
        self.promoted += 1

    def _drop_lowest(self) -> None:
        loser = self.main.lowest()
        self.floor = self.main.rank[loser][0]
        self.bytes_out += self.main.held[loser]
        self.main.drop(loser)
        self.wide.pop(loser, None)

    def _leave_window(self) -> None:
        key, size = self.window.popitem(last=False)
        self.in_window -= size
        while self.main.held and self.main.used + size > self.capacity - self.budget:
            if self.admission and self.sketch.count(key) <= self.sketch.count(self.main.lowest()):
                self.lost += 1
                self.bytes_out += size
                return
            self._drop_lowest()
        self.main.add(key, size, self._rank(key, size))

    def _adapt(self) -> None:
        seen = self.lookups - self.last_lookups
        if seen < min(max(10 * int(self.capacity / max(self.mean, 1.0)), 64), 100_000):
            return
        rate = (self.hits - self.last_hits) / seen
        if 0 <= rate < self.last_rate:
            self.grow = not self.grow
        step = int(self.capacity * 0.05) * (1 if self.grow else -1)
        self.budget = min(max(self.budget + step, self.least_window), max(int(self.capacity * 0.8), self.least_window))
        self.last_rate, self.last_hits, self.last_lookups = rate, self.hits, self.lookups

    def access(self, i: int, key: int, size: int) -> bool:
        self.sketch.add(key)
        self.lookups += 1
        if key in self.window:
            self.window.move_to_end(key)
        elif key in self.main.held:
            self.main.put(key, self._rank(key, size, self.main.held[key]))
            self._promote(key, size)
        else:
            self._admit(key, size)
            return False
        self.hits += 1
        return True

    def contains(self, key: int) -> bool:
        """Whether a key is held; no lookup is counted."""
        return key in self.window or key in self.main.held

    def region(self, key: int) -> str | None:
        return "window" if key in self.window else "main" if key in self.main.held else None

    def residency(self, key: int) -> str | None:
        return None if not self.contains(key) else "unpacked" if key in self.wide else "stored"

    def keys(self) -> list[int]:
        return sorted([*self.window, *self.main.held])

    def remove(self, key: int) -> bool:
        """Forget a key without counting an eviction."""
        if key in self.window:
            self.in_window -= self.window.pop(key)
        elif key in self.main.held:
            self.main.drop(key)
            self.main.evicted -= 1
            self.wide.pop(key, None)
        else:
            return False
        return True

    def clear(self) -> None:
        for key in self.keys():
            self.remove(key)
        self.floor = 0.0

    def reset_stats(self) -> None:
        self.lookups = self.hits = self.last_lookups = self.last_hits = self.promoted = self.lost = self.main.evicted = self.bytes_in = self.bytes_out = 0

    def _admit(self, key: int, size: int) -> None:
        if size > self.capacity:
            return
        self.window[key] = size
        self.in_window += size
        self.admitted += 1
        self.bytes_in += size
        self.mean += (size - self.mean) / self.admitted
        self.sketch.limit = 10 * max(1, int(self.capacity / max(self.mean, 1.0)))
        if self.adaptive:
            self._adapt()
        while self.in_window > self.budget and len(self.window) > 1:
            self._leave_window()
        while self.main.held and self.in_window + self.main.used > self.capacity:
            self._drop_lowest()


POLICIES: dict[str, Callable] = {
    "lru": Lru,
    "lfu": Lfu,
    "belady": Belady,
    "admitting": Admitting,
    "always_admitting": lambda c, log: Admitting(c, log, admission=False),
    "adaptive": lambda c, log: Admitting(c, log, adaptive=True),
}


def replay(keys: list[int], sizes: list[int], capacity: int, policy: str) -> dict[str, int]:
    cache, hits, read = POLICIES[policy](capacity, keys), 0, 0
    for i, (key, size) in enumerate(zip(keys, sizes, strict=True)):
        if cache.access(i, key, size):
            hits += 1
        else:
            read += size
    return {"hits": hits, "misses": len(keys) - hits, "bytes_read": read, "evictions": cache.evicted}


def rates(out: dict[str, int], bytes_in: int = 0, bytes_out: int = 0) -> dict[str, float]:
    """Hit rate, bytes read a lookup, and the share of admitted bytes that went again; all 0 where there is nothing."""
    n = out["hits"] + out["misses"]
    return {"hit_rate": out["hits"] / n if n else 0.0, "bytes_per_lookup": out["bytes_read"] / n if n else 0.0, "churn": bytes_out / bytes_in if bytes_in else 0.0}


#: Accesses of a packed stretch of the log.
STRETCH = 1 << 16
# Of a key never used again, and of one used next where the log has no place.
NEVER, LAST = 2**63 - 1, 2**63 - 2


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted accesses (part, key, size, after) as stretches: the distinct (key, size), which of them each access is, and
    after. Fails on an access without key or size."""
    held: list[np.ndarray] = []
    part = seq = n = 0

    def out() -> pa.RecordBatch:
        nonlocal held, seq
        rows, held = np.concatenate(held, axis=1), []
        own, at = np.unique(rows[:2], axis=1, return_inverse=True)
        at, seq = at.reshape(-1).astype(np.uint8 if own.shape[1] <= 256 else np.uint32), seq + 1
        made = [[part], [seq], [own[0].tobytes()], [own[1].tobytes()], [_packed(at)], [_packed(rows[2])]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["part", "seq", "keys", "sizes", "which", "after"])

    for b in batches:
        if not b.num_rows:
            continue
        part, rows = b["part"][0].as_py(), np.stack([b[c].cast(pa.int64()).to_numpy(zero_copy_only=True) for c in ("key", "size", "after")])
        while rows.shape[1]:
            now, rows = rows[:, : STRETCH - n], rows[:, STRETCH - n :]
            held.append(now)
            n += now.shape[1]
            if n == STRETCH:
                yield out()
                n = 0
    if held:
        yield out()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results by (policy, capacity) of stretches in order, one group after the other."""
    group = cache = None
    hits = misses = read = 0

    def out() -> pa.RecordBatch:
        made = {"policy": [group[0]], "capacity": [group[1]], "hits": [hits], "misses": [misses], "bytes_read": [read], "evictions": [cache.evicted]}
        return pa.RecordBatch.from_pydict(made, pa.schema([("policy", pa.string()), *[(c, pa.int64()) for c in list(made)[1:]]]))

    for b in batches:
        for r in b.to_pylist():
            if (r["policy"], r["capacity"]) != group:
                if group:
                    yield out()
                group, hits, misses, read = (r["policy"], r["capacity"]), 0, 0, 0
                cache = POLICIES[group[0]](group[1], [])
            keys, sizes = (np.frombuffer(r[c], np.int64) for c in ("keys", "sizes"))
            which = np.frombuffer(zlib.decompress(r["which"]), np.uint8 if len(keys) <= 256 else np.uint32)
            if isinstance(cache, Belady):
                cache.after = np.frombuffer(zlib.decompress(r["after"]), np.int64).tolist()
            for i, (key, size) in enumerate(zip(keys[which].tolist(), sizes[which].tolist(), strict=True)):
                if cache.access(i, key, size):
                    hits += 1
                else:
                    misses += 1
                    read += size
    if group:
        yield out()


def sweep(log: DataFrame, shares: tuple[float, ...], policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """(policy, capacity, hits, misses, bytes_read, evictions) of a log (i, key, size) in the order of i, then key;
    capacities are shares of the bytes of all distinct keys."""
    whole = log.groupBy("key").agg(F.max("size").alias("size")).agg(F.sum("size").alias("whole"))
    grid = whole.select(F.explode(F.array(*[F.greatest(F.lit(1), F.floor(F.col("whole") * s)) for s in shares])).alias("capacity")).distinct()
    grid = grid.select(F.explode(F.array(*map(F.lit, policies))).alias("policy"), "capacity")
    log = log.select("i", "key", "size")
    # Places of the next uses are compared, so they stand for the places in the log themselves.
    after = F.lead(F.coalesce("i", F.lit(LAST)), 1, NEVER).over(Window.partitionBy("key").orderBy(F.asc_nulls_last("i")))
    at = log.withColumn("after", after if "belady" in policies else F.lit(0).cast("long"))
    at = at.orderBy(F.asc_nulls_last("i"), "key", "size").select(F.spark_partition_id().alias("part"), "key", "size", "after")
    packed = at.mapInArrow(_pack, "part int, seq long, keys binary, sizes binary, which binary, after binary")
    rows = packed.crossJoin(F.broadcast(grid))  # a few (policy, capacity) rows
    rows = rows.withColumn("after", F.when(F.col("policy") == "belady", F.col("after")))
    # By range, not by hash: a task a fold, where a hash would lay several into one.
    rows = rows.repartitionByRange(len(shares) * len(policies), "policy", "capacity").sortWithinPartitions("policy", "capacity", "part", "seq")
    return rows.mapInArrow(_fold, "policy string, capacity long, hits long, misses long, bytes_read long, evictions long")
