"""Streaming folds against the same folds over whole logs, fed in several triggers."""

import random

import pytest

from moetrace.operators import bytecache
from moetrace.streaming import folds


@pytest.fixture
def fed(spark, tmp_path):
    """A stream of the rows of a table, a file and trigger at a time, and what it gives in the end."""

    def run(rows, schema, made, mode):
        where = tmp_path / "in"
        for i in range(0, len(rows), -(-len(rows) // 3)):
            spark.createDataFrame(rows[i : i + -(-len(rows) // 3)], schema).coalesce(1).write.mode("append").parquet(str(where))
        # Files are taken oldest first; each append is one file.
        stream = made(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(where)))
        name = f"t{random.randrange(1 << 30)}"
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    return run


@pytest.mark.parametrize("policy", ["lru", "admitting"])
def test_cache(fed, policy):
    rng = random.Random(1)
    rows = [(i % 2, i, min(rng.randrange(30), rng.randrange(30)), 100) for i in range(600)]
    got = fed(rows, "shard long, i long, key long, size long", lambda s: folds.cache(s, policy, 1000), "update")
    for shard in (0, 1):
        own = [r for r in rows if r[0] == shard]
        want = bytecache.replay([r[2] for r in own], [100] * len(own), 1000, policy)
        last = max((r for r in got if r.shard == shard), key=lambda r: r.lookups)
        assert (last.lookups, last.hits, last.bytes_read, last.evictions) == (len(own), want["hits"], want["bytes_read"], want["evictions"])


def test_belady_is_refused(spark):
    with pytest.raises(ValueError):
        folds.cache(None, "belady", 10)


def test_tokens_come_whole(fed):
    rows = [(t, la, [t, la]) for t in range(20) for la in range(3)]
    random.Random(2).shuffle(rows)
    rows = [r for r in rows if r[:2] != (7, 1)]
    got = fed(rows, "token long, layer int, experts array<int>", lambda s: folds.complete_tokens(s, 3), "append")
    assert sorted((r.token, r.layer, tuple(r.experts)) for r in got) == sorted((t, la, (t, la)) for t in range(20) if t != 7 for la in range(3))


def test_windows_and_frequencies(fed):
    rows = [(0, i, i in (0, 25)) for i in range(60)]
    got = fed(rows, "shard long, i long, marks boolean", lambda s: folds.count_windows(s, 10), "append")
    assert sorted((r.domain, r.win, r.rows) for r in got) == [(1, 0, 10), (1, 1, 10), (2, 0, 10), (2, 1, 10), (2, 2, 10)]


def test_frequencies(fed):
    rows = [(0, i, i % 3) for i in range(30)]
    got = fed(rows, "shard long, i long, key long", lambda s: folds.frequencies(s, 100), "update")
    assert max(r.estimate for r in got if r.key == 0) == 10


def test_workload(spark):
    s = folds.workload(spark, 100)
    assert s.isStreaming and s.columns == ["shard", "i", "key", "size"]
