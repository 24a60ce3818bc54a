"""Layout files, conversion, prefill orders, caches against published hit rates, and scalar functions."""

import json
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from moetrace import catalog
from moetrace.functions import scalars
from moetrace.functions.scalars import Json
from moetrace.operators import bytecache, ordering, prefill
from moetrace.sources import layouts, tensors, traces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(la, e, rng.choice(["Q4", "Q8", "BF16"]), bytearray(rng.randbytes(rng.choice([1, 4096, 4097, 12345])))) for la in range(2) for e in range(5)]
    payloads = spark.createDataFrame(rows, "layer int, expert int, precision string, payload binary")
    order = spark.createDataFrame([(0, 3, 0), (0, 1, 1), (1, 4, 0)], "layer int, expert int, place int")
    edges = spark.createDataFrame([(1, 0, 4, 0.42), (0, 1, 3, 0.81)], "layer int, a int, b int, weight double")
    path = str(tmp_path_factory.mktemp("layout") / "x.layout")
    layout = layouts.lay_out(payloads, order)
    told = layouts.write_file(path, layout, payloads, edges, "a model")
    return path, payloads, layout, told


def test_layout_file(spark, stored):
    path, payloads, layout, told = stored
    back, edges, head = layouts.open_file(spark, path)
    assert head["model"] == "a model" and (head["n_layers"], head["n_entries"], told["experts"]) == (2, 10, 10)
    assert back.exceptAll(layout.select(back.columns)).count() == layout.select(back.columns).exceptAll(back).count() == 0
    assert [r.expert for r in back.orderBy("pos").collect()] == [3, 1, 0, 2, 4, 4, 0, 1, 2, 3]
    assert all(r.offset % 4096 == 0 for r in back.collect())
    assert [(r.layer, r.a, r.b, round(r.weight, 6)) for r in edges.collect()] == [(0, 1, 3, 0.81), (1, 0, 4, 0.42)]
    assert layouts.verify(payloads, layouts.read_experts(path, back, head)).count() == 0
    run = back.where("layer = 0").orderBy("offset").limit(2).agg(F.min("offset").alias("file_offset"), F.sum("len").alias("n")).selectExpr("file_offset", "cast(8192 as bigint) as span")
    assert len(layouts.execute(path, run, head).first()["payload"]) == 8192


def test_layout_corruption(spark, stored, tmp_path):
    path, _, layout, _ = stored
    raw = bytearray(open(path, "rb").read())
    head = layouts.decode_header(bytes(raw))
    bad = str(tmp_path / "bad")

    def opened(at, n=None):
        x = bytearray(raw)
        x[at] ^= 1
        open(bad, "wb").write(x[:n])
        return layouts.open_file(spark, bad)

    for at, said in ((0, "not a layout"), (20, "corrupt header"), (head["index_at"] + 9, "corrupt index")):
        with pytest.raises(ValueError, match=said):
            opened(at)
    with pytest.raises(ValueError, match="cut short"):
        opened(120, len(raw) - 1)
    with pytest.raises(ValueError, match="ends inside"):
        opened(0, 40)
    back, _, own = opened(head["data_at"])
    with pytest.raises(Exception, match="corrupt payload"):
        layouts.read_experts(bad, back, own).collect()
    with pytest.raises(Exception, match="twice in the layout"):
        layouts.lay_out(spark.createDataFrame([(0, 1, "Q4", bytearray(b"a"))] * 2, "layer int, expert int, precision string, payload binary")).collect()
    none = spark.createDataFrame([], "layer int, expert int, precision string, payload binary")
    assert layouts.write_file(bad, layouts.lay_out(none), none)["experts"] == 0 and layouts.open_file(spark, bad)[0].count() == 0


def test_conversion(spark, tmp_path):
    rng, head, body = np.random.default_rng(1), {}, b""
    for layer in range(2):
        for name, shape in (("input_linear.weight", [3, 4, 8]), ("output_linear.weight", [3, 4, 4]), ("router.layer.weight", [3, 8])):
            raw = rng.bytes(2 * int(np.prod(shape)))
            head[f"model.layers.{layer}.block_sparse_moe.{name}"] = {"dtype": "BF16", "shape": shape, "data_offsets": [len(body), len(body) + len(raw)]}
            body += raw
    text = json.dumps(head).encode()
    path = tmp_path / "m.tensors"
    path.write_bytes(len(text).to_bytes(8, "little") + text + body)
    found = tensors.parse_headers(spark.read.format("binaryFile").load(str(path)).select("path", "content"))
    payloads = layouts.gather(tensors.expert_parts(found), found, str(path), 8 + len(text))
    at = lambda n, e, size: body[head[n]["data_offsets"][0] + e * size :][:size]
    want = {(la, e): at(f"model.layers.{la}.block_sparse_moe.input_linear.weight", e, 64) + at(f"model.layers.{la}.block_sparse_moe.output_linear.weight", e, 32) for la in (0, 1) for e in range(3)}
    assert {(r.layer, r.expert): bytes(r.payload) for r in payloads.collect()} == want
    layouts.write_file(str(tmp_path / "out"), layouts.lay_out(payloads), payloads)
    back, _, own = layouts.open_file(spark, str(tmp_path / "out"))
    read = layouts.read_experts(str(tmp_path / "out"), back, own)
    assert layouts.verify(payloads, read).count() == 0
    other = read.where("expert < 2").withColumn("payload", F.when((F.col("layer") == 0) & (F.col("expert") == 1), F.expr("concat(substring(payload, 1, 5), X'00', substring(payload, 7))")).otherwise(F.col("payload")))
    faults = {(r.layer, r.expert): (r.fault, r.first_difference) for r in layouts.verify(payloads, other).collect()}
    assert faults[0, 2] == ("missing", None) and (0, 1) not in faults or faults[0, 1] == ("bytes", 5)
    with pytest.raises(Exception, match="beyond the file"):
        layouts.read_ranges(str(path), spark.createDataFrame([(0, 1 << 20)], "offset long, len long"), 0).collect()


@pytest.mark.parametrize(("tokens", "top", "experts"), [(64, 2, 16), (129, 4, 32), (7, 8, 8), (1, 1, 4)])
def test_orders_give_the_same_bits(spark, tokens, top, experts):
    rng = np.random.default_rng(tokens)
    rows = [(0, t, s, int(e), float(rng.random())) for t in range(tokens) for s, e in enumerate(rng.permutation(experts)[:top])]
    routing = spark.createDataFrame(rows, "layer int, token long, slot int, expert int, weight double")
    x = spark.createDataFrame([(t, rng.normal(size=3).tolist()) for t in range(tokens)], "token long, x array<double>")
    fn = lambda layer, expert, v: np.tanh(v * (expert + 1)) + layer
    a, b = (dict((r.token, r.y) for r in how(routing, x, fn).collect()) for how in (lambda *z: prefill.expert_major(*z, tokens=16), prefill.token_major))
    assert a == b and len(a) == tokens
    calls = prefill.calls(routing)
    assert calls.agg(F.sum("rows")).first()[0] == tokens * top and calls.where("calls <> 1").count() == 0
    batches = prefill.invert(routing)
    m = prefill.metrics(batches).first()
    assert m.assignments == tokens * top and m.reads == batches.count() == m.assignments - m.reads_saved
    off = spark.createDataFrame([(0, e, (experts - e) * 4096) for e in range(experts - 1)], "layer int, expert int, offset long")
    steps = prefill.schedule(batches, off).orderBy("step").collect()
    assert [r.expert for r in steps] == sorted((r.expert for r in steps), reverse=True) and prefill.retain(batches, off).count() == len(steps)
    assert prefill.metrics(batches.limit(0)).first().mean_batch == 0.0


# Hit rates published for these workloads: (workload, entries, policy, rate).
PUBLISHED = [
    (("hot_set", 16, 200, 4, 7), 16, "lru", 0.562), (("hot_set", 16, 200, 4, 7), 16, "always_admitting", 0.668), (("hot_set", 16, 200, 4, 7), 16, "admitting", 0.762), (("hot_set", 16, 200, 4, 7), 16, "belady", 0.783),
    (("domain_blocks", 4, 12, 300, 24, 11), 24, "lru", 0.960), (("domain_blocks", 4, 12, 300, 24, 11), 24, "always_admitting", 0.946), (("domain_blocks", 4, 12, 300, 24, 11), 24, "admitting", 0.891), (("domain_blocks", 4, 12, 300, 24, 11), 24, "belady", 0.972),
    (("skewed_layer", 64, 20_000, 13), 24, "lru", 0.617), (("skewed_layer", 64, 20_000, 13), 24, "always_admitting", 0.671), (("skewed_layer", 64, 20_000, 13), 24, "admitting", 0.716), (("skewed_layer", 64, 20_000, 13), 24, "belady", 0.835),
    (("hot_set", 16, 200, 4, 7), 24, "admitting", 0.796), (("hot_set", 16, 200, 4, 7), 24, "adaptive", 0.786), (("skewed_layer", 64, 20_000, 13), 16, "admitting", 0.521), (("skewed_layer", 64, 20_000, 13), 16, "adaptive", 0.483), (("skewed_layer", 64, 20_000, 13), 24, "adaptive", 0.677), (("domain_blocks", 4, 12, 300, 24, 11), 24, "adaptive", 0.910),
]


@pytest.mark.parametrize(("workload", "entries", "policy", "rate"), PUBLISHED)
def test_published_hit_rates(workload, entries, policy, rate):
    keys = getattr(traces, workload[0])(*workload[1:])
    size = 1 << 20
    got = bytecache.replay(keys, [size] * len(keys), entries * size, policy)["hits"] / len(keys)
    assert abs(got - rate) < 0.0006, got


def test_cache_surface():
    c = bytecache.Admitting(10_000, [], unpacked={k: 900 for k in range(20)})
    for _ in range(12):
        for k in range(8):
            c.access(0, k, 500)
    assert c.promoted > 0 and {c.residency(k) for k in range(8)} >= {"unpacked"} and c.in_window + c.main.used <= c.capacity
    n = c.lookups
    assert c.contains(3) and c.region(99) is None and c.keys() == list(range(8)) and c.lookups == n
    assert c.remove(3) and not c.remove(3) and c.keys() == [0, 1, 2, 4, 5, 6, 7]
    c.clear()
    c.reset_stats()
    assert c.keys() == [] and c.in_window == c.main.used == 0 and c.lookups == 0 and c.evicted == 0
    assert bytecache.rates({"hits": 0, "misses": 0, "bytes_read": 0}) == {"hit_rate": 0.0, "bytes_per_lookup": 0.0, "churn": 0.0}
    assert bytecache.rates({"hits": 3, "misses": 1, "bytes_read": 8}, 4, 2) == {"hit_rate": 0.75, "bytes_per_lookup": 2.0, "churn": 0.5}
    plain, promoting = (bytecache.Admitting(10_000, [], unpacked=u) for u in (None, {k: 500 for k in range(30)}))
    keys = [random.Random(i).randrange(30) for i in range(2000)]
    assert [plain.access(i, k, 500) for i, k in enumerate(keys)] == [promoting.access(i, k, 500) for i, k in enumerate(keys)]


def test_capture_counts_the_gap(spark):
    order = spark.createDataFrame([(0, e, e, 4096) for e in range(4)], "layer int, expert int, place int, len long")
    edges = spark.createDataFrame([(0, 0, 1, 0.5), (0, 0, 2, 0.25), (0, 3, 0, 0.25)], "layer int, a int, b int, weight double")
    got = [ordering.capture_ratio(order, edges, w).first().captured for w in (0, 4096, 8192)]
    assert got == [0.5, 0.75, 1.0]
    assert ordering.is_permutation(order, order) and not ordering.is_permutation(order.where("expert > 0"), order)


def test_scalars(spark):
    row = spark.range(1)
    one = lambda c: row.select(c.alias("c")).first()["c"]
    assert one(F.crc32(F.lit(b"123456789"))) == 0xCBF43926 == zlib.crc32(b"123456789") and one(F.crc32(F.lit(b"a"))) == 0xE8B7BE43
    assert [one(scalars.align_up(F.lit(n))) for n in (0, 1, 4096, 4097)] == [0, 4096, 4096, 8192]
    assert [one(x) for x in scalars.unpack_key(scalars.pack_key(F.lit(47), F.lit(0xFFFF)))] == [47, 0xFFFF]
    assert [one(scalars.block_size(*map(F.lit, x))) for x in ((1 << 20, 2, 64, 4), (10, 2, 64, 4), (10, 0, 64, 4))] == [2048, 1, 1]
    assert scalars.latency_bytes() == 500_000 and one(scalars.window_bytes(F.lit(50))) == 1
    r = scalars.rates(F.lit(4e9), F.lit(1000), F.lit(2.0), F.lit(16))
    assert (one(r["gb_per_s"]), one(r["iops"]), one(r["latency_us"])) == (2.0, 500.0, 32000.0)
    assert one(scalars.rates(F.lit(0), F.lit(0), F.lit(2.0), F.lit(16))["latency_us"]) == 0.0
    assert [one(scalars.human(F.lit(n))) for n in (4096, 1 << 20, 3 << 20)] == ["4K", "1M", "3M"]
    assert [one(scalars.width(F.lit(d))) for d in ("F32", "BF16", "I8", "X")] == [4, 2, 1, None] and one(scalars.dtype_precision(F.lit("U8"))) is None
    assert one(scalars.precision_of(F.lit(6))) == "Q4"
    with pytest.raises(Exception, match="unknown precision"):
        one(scalars.precision_of(F.lit(9)))
    assert one(scalars.banner(F.lit("synthetic"), F.lit("m"), F.lit("c"))).startswith("SYNTHETIC")


def test_json():
    v = Json.parse('{"a": {"b": [1, 2.5, "x\\u00e9\\ud83d\\ude00"]}, "n": 7.0, "t": true}')
    assert v.get("a").get("b").array()[2].text() == "xé😀" and v.get("n").count() == 7 and v.get("t").count() is None
    assert v.get("z") is None and [k for k, _ in v.entries()] == ["a", "n", "t"] and v.get("a").get("b").array()[1].count() is None
    for bad in ("", "{", "[1,]", "{} x", "NaN", "'a'", '{"a" 1}', "01", '"\\x"'):
        with pytest.raises(ValueError):
            Json.parse(bad)


def test_plan_of_capped_reads_fails_on_missing(spark):
    from moetrace.sources import derive

    chosen = spark.createDataFrame([(0, 0, 1), (0, 0, 2)], "token long, layer int, expert int")
    layout = spark.createDataFrame([(0, 1, 0, 10)], "layer int, expert int, pos long, len long")
    with pytest.raises(Exception, match="not in the layout"):
        derive.place_wants(chosen, layout).collect()


@pytest.mark.parametrize("name", ["schedule_order", "warm_pass", "lookahead", "probe_widths", "projected_hidden", "hit_rate_at_target", "cache_workloads", "verdicts", "headline"])
def test_other_queries(spark, name):
    out = catalog.queries()[name](spark, SF).toPandas()
    assert len(out) and isinstance(out, pd.DataFrame)
