"""Queries of the engine against SQL in another engine, and its folds against plain loops."""

import random

import duckdb
import pandas as pd
import pytest

from moetrace import catalog
from moetrace.operators import folds

SF = "/root/testdata/sf0.001"


def _plain(df):
    cols = sorted(df.columns)
    rows = [tuple(None if pd.isna(v) else round(float(v), 6) if not isinstance(v, str) else v for v in r) for r in df[cols].itertuples(index=False)]
    return cols, sorted(rows, key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "events", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    assert _plain(catalog.queries()[name](spark, SF).toPandas()) == _plain(duck.execute(catalog.oracle_sql()[name]).df())


def _slow_lfu(keys, capacity):
    n, held, hits = {}, set(), 0
    for k in keys:
        n[k] = n.get(k, 0) + 1
        if k in held:
            hits += 1
        elif len(held) < capacity:
            held.add(k)
        else:
            v = min(held, key=lambda x: (n[x], x))
            if n[v] <= n[k]:
                held.remove(v)
                held.add(k)
    return hits


def _slow_belady(keys, capacity):
    held, hits = set(), 0
    for i, k in enumerate(keys):
        if k in held:
            hits += 1
            continue
        if len(held) >= capacity:
            use = {x: next((j for j in range(i + 1, len(keys)) if keys[j] == x), len(keys)) for x in held}
            held.remove(max(held, key=lambda x: use[x]))
        held.add(k)
    return hits


def test_folds_against_loops():
    rng = random.Random(3)
    for _ in range(20):
        keys, c = [rng.randrange(12) for _ in range(200)], rng.randrange(1, 10)
        assert folds.lfu(keys, c) == _slow_lfu(keys, c)
        # No order between the two: this Belady always admits, while LFU may turn a newcomer away.
        assert folds.belady(keys, c) == _slow_belady(keys, c)


def test_reuse_curve_against_loops(spark):
    held = {}
    for r in catalog.queries()["route_topk"](spark, SF).collect():
        held.setdefault((r.layer, r.token), set()).add(r.expert)
    layers, last = {k[0] for k in held}, max(k[1] for k in held)
    want = {(d, x): sum(len(held[x, t] & held[x, t + d]) for t in range(last - d + 1)) / (last - d + 1) / 4 for d in range(1, 17) for x in layers}
    got = {(r.d, r.layer): float(r.reuse) for r in catalog.queries()["reuse_curve"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
