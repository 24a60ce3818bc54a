"""Byte caches, storage orders and capped plans against plain loops and cases known beforehand."""

import random

import pandas as pd
import pytest

from moetrace import catalog
from moetrace.operators import bytecache, folds, ordering

SF = "/root/testdata/sf0.001"


def _slow(policy, keys, sizes, capacity):
    """Straight scans in place of heaps."""
    n, held, hits, evicted = {}, {}, 0, 0
    last = {}
    for i, (k, s) in enumerate(zip(keys, sizes, strict=True)):
        n[k] = n.get(k, 0) + 1
        last[k] = i
        if k in held:
            hits += 1
            continue
        if s > capacity:
            continue
        while sum(held.values()) + s > capacity:
            if policy == "lru":
                v = min(held, key=last.get)
            elif policy == "lfu":
                v = min(held, key=lambda x: (n[x], x))
                if n[v] > n[k]:
                    break
            else:
                v = max(held, key=lambda x: (next((j for j in range(i + 1, len(keys)) if keys[j] == x), len(keys) + 1), x))
            del held[v]
            evicted += 1
        else:
            held[k] = s
    return hits, evicted


@pytest.mark.parametrize("policy", ["lru", "lfu", "belady"])
def test_byte_policies_against_scans(policy):
    rng = random.Random(5)
    for _ in range(15):
        size = {k: rng.randrange(1, 40) for k in range(15)}
        keys = [min(rng.randrange(15), rng.randrange(15)) for _ in range(250)]
        sizes, c = [size[k] for k in keys], rng.randrange(20, 150)
        out = bytecache.replay(keys, sizes, c, policy)
        assert (out["hits"], out["evictions"]) == _slow(policy, keys, sizes, c)


def test_equal_sizes_agree_with_counts():
    keys = [random.Random(i).randrange(20) for i in range(600)]
    for c in (3, 7, 12):
        for policy in ("lfu", "belady"):
            assert bytecache.replay(keys, [10] * len(keys), c * 10, policy)["hits"] == folds.POLICIES[policy](keys, c)


def test_admission_protects_a_hot_set():
    keys, new = [], 1000
    for _ in range(300):
        keys += range(16)
        keys += range(new, new + 4)
        new += 4
    rate = {p: bytecache.replay(keys, [100] * len(keys), 1600, p)["hits"] / len(keys) for p in bytecache.POLICIES}
    assert rate["lru"] == 0 and rate["admitting"] > 0.7 > rate["always_admitting"]
    # Belady admits every newcomer, so it bounds only the policies that do too.
    assert max(rate["lru"], rate["always_admitting"]) <= rate["belady"]


def test_entries_larger_than_the_cache_stay_out():
    for p in bytecache.POLICIES:
        assert bytecache.replay([1, 1, 1], [50] * 3, 10, p) == {"hits": 0, "misses": 3, "bytes_read": 150, "evictions": 0}
        assert bytecache.replay([], [], 10, p)["hits"] == 0


def test_sweep_goes_through_the_log_in_stretches(spark):
    rng = random.Random(9)
    size = {k: rng.randrange(1, 40) for k in range(600)}
    keys = [min(rng.randrange(600), rng.randrange(600)) for _ in range(bytecache.STRETCH + 5000)]
    log = spark.createDataFrame(pd.DataFrame({"i": range(0, 3 * len(keys), 3), "key": keys, "size": [size[k] for k in keys]}).sample(frac=1, random_state=1))
    # Two shares that are the same capacity are one.
    swept = bytecache.sweep(log, (0.1, 0.10000001, 0.4))
    plan = swept._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and plan.count("MapInArrow") >= 2
    got = {(r.policy, r.capacity): r.asDict() for r in swept.collect()}
    whole = sum(size[k] for k in set(keys))
    for policy in bytecache.POLICIES:
        for c in {int(whole * s) for s in (0.1, 0.4)}:
            assert got.pop((policy, c)) == {"policy": policy, "capacity": c, **bytecache.replay(keys, [size[k] for k in keys], c, policy)}
    assert not got


def test_sketch_saturates_and_ages():
    s = bytecache.Sketch()
    s.limit = 1000
    for _ in range(40):
        s.add(7)
    assert s.count(7) == 15 and s.count(8) == 0
    s.limit = s.age + 1
    s.add(9)
    assert s.count(7) == 7


def test_chains():
    assert ordering.chain_order([0, 1, 2, 3], []) == [0, 1, 2, 3]
    groups = [(g + 16 * i, g + 16 * j, 0.5) for g in range(16) for i in range(4) for j in range(i + 1, 4)]
    order = ordering.chain_order(range(64), groups)
    assert sorted(order) == list(range(64))
    assert all({e % 16 for e in order[i : i + 4]} == {order[i] % 16} for i in range(0, 64, 4))


K = 64 << 10


@pytest.mark.parametrize(
    ("want", "options", "spans"),
    [
        ([0, 1, 2, 3], {"gap": 0}, [4]),
        ([0, 3], {}, [4]),
        ([0, 2], {"gap": 0}, [1, 1]),
        (list(range(8)), {"coalesce": False}, [1] * 8),
        (list(range(16)), {"cap": 4 * K}, [4] * 4),
        ([7, 1, 4, 1], {"coalesce": False}, [1] * 3),
        ([2, 3, 5, 40, 41, 43, 90, 91], {}, [4, 4, 2]),
        ([5], {"cap": 1}, [1]),
    ],
)
def test_capped_plans(spark, want, options, spans):
    rows = spark.createDataFrame(pd.DataFrame({"q": [1] * len(want), "off": [w * K for w in want], "len": [K] * len(want)}))
    out = ordering.capped_plan(rows, ["q"], **options).orderBy("req").toPandas()
    assert out["span"].tolist() == [s * K for s in spans]
    assert out["wanted"].sum() == len(set(want)) * K


@pytest.mark.parametrize("name", ["byte_cache_sweep", "chain_order", "chain_capture", "plan_capped"])
def test_queries_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_chains_capture_more_than_the_index(spark):
    out = catalog.queries()["chain_capture"](spark, SF).groupBy("placing").avg("captured").toPandas().set_index("placing")
    assert out.loc["chains"].iloc[0] >= out.loc["index"].iloc[0]
