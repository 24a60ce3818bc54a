"""The registered queries of the routing-trace engine, and their SQL for the checking engine.

The analyses in plans.statements are text that both engines run, over relations derived separately; the other queries
have SQL of their own, written apart from what Spark runs."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import bytecache, folds, lookahead, ordering, prefill, probes
from .plans import report
from .plans.analysis import Analysis
from .plans.statements import build
from .sources import derive, layouts, tensors, traces

STATEMENTS = build(derive.LAYERS, derive.EXPERTS, derive.TOP)
#: What Spark runs: the same text, but for what it adds up without joining pairs.
RUN = build(derive.LAYERS, derive.EXPERTS, derive.TOP, pairs=False)
CAPACITIES = (1, 3, 8, 16, 32, 48, 80, 120, 160)
GAP = 1 << 16

Query = Callable[[SparkSession, str], DataFrame]


def _names(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def _query(sql: str) -> Query:
    return lambda spark, sf_dir: spark.sql(sql, **{n: derive.BUILD[n](spark, sf_dir) for n in _names(sql)})


EDGES, OFFSETS = _query(STATEMENTS["coact_edges"]), _query(STATEMENTS["layout_offsets"])


def _sweep(policy: str) -> Query:
    return lambda spark, sf_dir: folds.sweep(derive.log(spark, sf_dir), CAPACITIES, policy)


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with sizes by the layout's rule."""
    size = F.expr("1000 + ((key & 4294967295) * 7919 + shiftright(key, 32) * 104729) % 60000")
    return bytecache.sweep(derive.log(spark, sf_dir).withColumn("size", size), (0.05, 0.2, 0.5))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.order_layers(derive.layout(spark, sf_dir), EDGES(spark, sf_dir))


def _order(spark: SparkSession, sf_dir: str, chains: bool) -> DataFrame:
    layout = derive.layout(spark, sf_dir)
    at = _chains(spark, sf_dir) if chains else layout.select("layer", "expert", F.col("expert").alias("place"))
    return at.join(layout.select("layer", "expert", "len"), ["layer", "expert"])


def _index_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.capture_ratio(_order(spark, sf_dir, False), EDGES(spark, sf_dir), GAP)


def _capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of edge weight that a read bridges, by index order and by chains."""
    both = [ordering.capture_ratio(_order(spark, sf_dir, chains), EDGES(spark, sf_dir), GAP).withColumn("placing", F.lit("chains" if chains else "index")) for chains in (False, True)]
    return both[0].union(both[1]).select("placing", "layer", "captured")


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.capped_plan(derive.wants(spark, sf_dir), ["token", "layer"], gap=GAP, cap=1 << 17)


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.linear_probe(derive.hidden(spark, sf_dir), derive.trace(spark, sf_dir), derive.EXPERTS, derive.EXPERTS, 2 * derive.TOP, (1, 2))


def _lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookahead.lookahead(derive.hidden(spark, sf_dir), derive.trace(spark, sf_dir), derive.LAYERS, derive.EXPERTS, derive.TOP, epochs=10)


def _widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = probes.pairs(derive.hidden(spark, sf_dir), derive.trace(spark, sf_dir), 2)
    cut = 1 + int((rows.agg(F.max("token")).first()[0] or 0) * 0.7)
    return lookahead.mlp_recalls(rows, derive.EXPERTS, 2 * derive.TOP, cut, (8, 32), epochs=5)


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lookahead.project(derive.hidden(spark, sf_dir), derive.EXPERTS, 4)
    return at.select("token", "layer", F.round(F.aggregate("h", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace with weights that are sixteenths: sums of such numbers are exact in any order."""
    return derive.trace(spark, sf_dir).withColumn("weight", (derive.TOP - F.col("slot")) / 16.0)


def _activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.trace(spark, sf_dir).select("token").distinct().select("token", F.array((F.col("token") % 97).cast("double"), (F.col("token") % 31).cast("double")).alias("x"))


def _executed(by_token: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        how = prefill.token_major if by_token else prefill.expert_major
        at = how(_routing(spark, sf_dir), _activations(spark, sf_dir), prefill.mock_expert)
        return at.select("layer", "token", F.col("y")[0].alias("y0"), F.col("y")[1].alias("y1"))

    return run


EXECUTED_SQL = """SELECT layer, token, sum((4 - slot) / 16.0e0 * ((token % 97) * ((expert % 7) + 1) / 8.0e0 + (layer % 3) / 4.0e0)) AS y0,
  sum((4 - slot) / 16.0e0 * ((token % 31) * ((expert % 7) + 1) / 8.0e0 + (layer % 3) / 4.0e0)) AS y1 FROM {trace} GROUP BY layer, token"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches' rows as text, to compare them whole."""
    at = prefill.invert(_routing(spark, sf_dir))
    told = F.transform("rows", lambda x: F.concat_ws(":", x["token"].cast("string"), x["slot"].cast("string"), (x["weight"] * 16).cast("int").cast("string")))
    return at.select("layer", "expert", F.array_join(told, ",").alias("rows"))


LISTS_SQL = "SELECT layer, expert, string_agg(token || ':' || slot || ':' || (4 - slot), ',' ORDER BY token, slot) AS rows FROM {trace} GROUP BY layer, expert"


def _scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the chains' order on disk."""
    order = _order(spark, sf_dir, True)
    placed = layouts.place(order.select("layer", "expert", "place", "len"))
    batches = prefill.retain(prefill.invert(_routing(spark, sf_dir)), placed)
    return prefill.schedule(batches, placed).select("layer", "step", "expert", "offset", F.size("rows").alias("rows_in"))


def _warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = layouts.place(_order(spark, sf_dir, False))
    steps = prefill.schedule(prefill.invert(_routing(spark, sf_dir)), placed.select("layer", "expert", "offset"))
    return prefill.warm_pass(steps.join(placed.select("layer", "expert", "len"), ["layer", "expert"]))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_expert = prefill.calls(_routing(spark, sf_dir)).select("layer", "expert", F.col("calls").alias("expert_major"), "rows")
    return by_expert.join(prefill.calls(_routing(spark, sf_dir), True).select("layer", "expert", F.col("calls").alias("token_major")), ["layer", "expert"])


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs are lines here, and a line that begins with THE starts a subject."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select(F.col("doc_id").alias("path"), "text")
    return traces.read_corpus(texts, "THE", "\n").groupBy("path").agg(F.count("*").alias("paragraphs"), F.max("domain").alias("subjects"), F.count_if("starts").alias("starts"), F.min(F.when(F.col("starts"), F.col("idx"))).alias("first_start"))


# A subject's line is dropped here as it has no line below it: the starts are the next paragraphs that stay.
CORPUS_SQL = r"""
WITH l AS (SELECT doc_id AS path, i, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS t FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
m AS (SELECT path, i, t, upper(t) LIKE 'THE%' AS mark, count(*) FILTER (upper(t) LIKE 'THE%') OVER (PARTITION BY path ORDER BY i) AS domain FROM l WHERE t <> ''),
k AS (SELECT path, domain, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS idx, lag(domain) OVER (PARTITION BY path ORDER BY i) AS was FROM m WHERE NOT mark),
a AS (SELECT path, bool_or(mark) AS has FROM m GROUP BY path),
s AS (SELECT k.*, CASE WHEN has THEN domain <> coalesce(was, 0) ELSE idx = 0 END AS starts FROM k JOIN a USING (path))
SELECT path, count(*) AS paragraphs, max(domain) AS subjects, count(*) FILTER (starts) AS starts, min(idx) FILTER (starts) AS first_start FROM s GROUP BY path"""

CAPTURE_SQL = """SELECT e.layer, round(coalesce(sum(CASE WHEN CASE WHEN x.off <= y.off THEN y.off - (x.off + x.size) ELSE x.off - (y.off + y.size) END <= 65536 THEN weight ELSE 0 END) / nullif(sum(weight), 0), 0), 6) AS captured
FROM (SELECT p.layer, p.a, p.b, round(p.n / p.t, 6) AS weight FROM (SELECT a.layer, a.expert AS a, b.expert AS b, CAST(count(*) AS DOUBLE) AS n, (SELECT count(DISTINCT token) FROM {trace} q WHERE q.layer = a.layer) AS t
  FROM {trace} a, {trace} b WHERE a.token = b.token AND a.layer = b.layer AND a.expert < b.expert GROUP BY a.layer, a.expert, b.expert) p WHERE p.n / p.t >= 0.02) e
JOIN (SELECT layer, expert, (len + 4095) // 4096 * 4096 AS size, sum((len + 4095) // 4096 * 4096) OVER (PARTITION BY layer ORDER BY expert) - (len + 4095) // 4096 * 4096 AS off FROM {layout}) x ON x.layer = e.layer AND x.expert = e.a
JOIN (SELECT layer, expert, (len + 4095) // 4096 * 4096 AS size, sum((len + 4095) // 4096 * 4096) OVER (PARTITION BY layer ORDER BY expert) - (len + 4095) // 4096 * 4096 AS off FROM {layout}) y ON y.layer = e.layer AND y.expert = e.b
GROUP BY e.layer"""

#: (name, dtype, first axis, other elements, bytes of an element): a small model's tensors.
TENSORS = [(f"model.layers.{layer}.{name}", "BF16", n, rest, 2) for layer in range(2) for name, n, rest in (("block_sparse_moe.input_linear.weight", 3, 32), ("block_sparse_moe.output_linear.weight", 3, 16), ("block_sparse_moe.router.layer.weight", 3, 8), ("self_attn.q_proj.weight", 4, 4))]


def _tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, dtype, [n, rest], 0, n * rest * width) for name, dtype, n, rest, width in TENSORS]
    return tensors.expert_parts(spark.createDataFrame(rows, "name string, dtype string, shape array<bigint>, begin bigint, upto bigint"))


TENSOR_SQL = f"""SELECT CAST(layer AS INT) AS layer, CAST(e AS INT) AS expert, projection, name, e * len AS offset, len FROM (
  SELECT name, regexp_extract(name, '[.]layers[.]([0-9]+)[.]', 1) AS layer, regexp_extract(name, 'block_sparse_moe[.](.+)$', 1) AS projection, CAST(rest * width AS BIGINT) AS len, unnest(generate_series(0, n - 1)) AS e
  FROM (VALUES {", ".join(map(str, TENSORS))}) t(name, dtype, n, rest, width)) WHERE projection <> '' AND projection NOT LIKE 'router.%'"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as payloads: customers by market segment, laid out by balance first, then by key."""
    at = spark.read.parquet(f"{sf_dir}/customer.parquet")
    payloads = at.select((F.col("c_custkey") % 8).cast("int").alias("layer"), F.col("c_custkey").cast("int").alias("expert"), F.lit("Q4").alias("precision"), F.encode(F.repeat("c_name", 90), "UTF-8").alias("payload"))
    order = at.where("c_acctbal > 0").select((F.col("c_custkey") % 8).cast("int").alias("layer"), F.col("c_custkey").cast("int").alias("expert"), F.round(F.col("c_acctbal") * 100).cast("long").alias("place"))
    return layouts.lay_out(payloads, order).select("layer", "expert", "pos", "offset", "len", "precision")


PLACED_SQL = """SELECT layer, expert, row_number() OVER o - 1 AS pos, CAST(coalesce(sum((len + 4095) // 4096 * 4096) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, len, 'Q4' AS precision
FROM (SELECT CAST(c_custkey % 8 AS INT) AS layer, CAST(c_custkey AS INT) AS expert, CAST(strlen(c_name) * 90 AS BIGINT) AS len, CASE WHEN c_acctbal > 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) END AS place FROM customer)
WINDOW o AS (ORDER BY layer, place NULLS LAST, expert)"""


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = derive.accesses(spark, sf_dir)
    layer, expert = scalars.unpack_key(F.col("key"))
    return at.select("i", layer.alias("layer"), expert.alias("expert"), scalars.pack_key(layer, expert).alias("key"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions of the layout's entries."""
    n, off = F.col("len"), F.col("off")
    begin = scalars.slice_of(off, n, F.lit(1 << 16), F.lit(1 << 18))
    return OFFSETS(spark, sf_dir).select(
        "layer", "expert", scalars.align_up(n).alias("padded"), scalars.human(n * 64).alias("human"), F.round(scalars.reload_seconds(n), 9).alias("reload"), scalars.window_bytes(n).alias("window"),
        scalars.block_size(F.lit(1 << 20), F.col("expert"), n, F.lit(4)).alias("block"), begin["begin"].alias("slice_begin"), begin["end"].alias("slice_end"),
        scalars.accepts(off, scalars.align_up(n), 40960, True).alias("accepted"), scalars.verdict(n, F.lit(30000)).alias("verdict"), scalars.p_verdict(n / 1000000.0).alias("by_p"))


SIZES_SQL = """SELECT layer, expert, (len + 4095) // 4096 * 4096 AS padded, CASE WHEN len * 64 >= 1048576 THEN (len * 64 // 1048576) || 'M' ELSE (len * 64 // 1024) || 'K' END AS human, round(0.0001e0 + len / 5e9, 9) AS reload,
  greatest(1, CAST(floor(len * 0.01e0) AS BIGINT)) AS window, CASE WHEN expert = 0 THEN 1 ELSE greatest(1, 1048576 // (expert * len * 4)) END AS block,
  CASE WHEN off >= 65536 AND off - 65536 + len <= 262144 THEN off - 65536 END AS slice_begin, CASE WHEN off >= 65536 AND off - 65536 + len <= 262144 THEN off - 65536 + len END AS slice_end,
  (len + 4095) // 4096 * 4096 <= 40960 AS accepted, CASE WHEN len >= 30000 THEN 'pass' WHEN len >= 24000 THEN 'marginal' ELSE 'fail' END AS verdict, CASE WHEN len <= 10000 THEN 'pass' WHEN len <= 50000 THEN 'marginal' ELSE 'fail' END AS by_p
FROM (SELECT layer, expert, len, CAST(sum((len + 4095) // 4096 * 4096) OVER (ORDER BY pos) - (len + 4095) // 4096 * 4096 AS BIGINT) AS off FROM {layout})"""


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 20 experts declared, 16 are ever used."""
    declared = spark.range(80).selectExpr("cast(id div 20 as int) as layer", "cast(id % 20 as int) as expert")
    return ordering.profile(derive.trace(spark, sf_dir), declared)


PROFILE_SQL = """SELECT CAST(g.id // 20 AS INT) AS layer, CAST(g.id % 20 AS INT) AS expert, (SELECT count(DISTINCT token) FROM {trace} t WHERE t.layer = g.id // 20 AND t.expert = g.id % 20) AS hits, (SELECT count(DISTINCT token) FROM {trace} t WHERE t.layer = g.id // 20) AS tokens
FROM (SELECT unnest(generate_series(0, 79)) AS id) g"""


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label"), F.floor(F.col("vec_id") / 50).cast("long").alias("run"))
    return scalars.canonical(at, ["run"], "vec_id", "label").select("vec_id", F.col("part").cast("long").alias("part"))


CANONICAL_SQL = """SELECT vec_id, (SELECT count(DISTINCT y.label) FROM embeddings y WHERE y.vec_id // 50 = e.vec_id // 50 AND y.vec_id < (SELECT min(z.vec_id) FROM embeddings z WHERE z.vec_id // 50 = e.vec_id // 50 AND z.label = e.label)) AS part FROM embeddings e"""


def _capacity_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits at shares of all pairs, and what the capacity nearest a fifth of them gives."""
    at, total = derive.accesses(spark, sf_dir), derive.LAYERS * derive.EXPERTS
    swept = [folds.sweep(at, folds.capacities(total), p) for p in folds.POLICIES]
    return folds.nearest(swept[0].union(swept[1]).union(swept[2]), int(total * report.TARGET)).select("policy", "capacity", F.round("hit_rate", 6).alias("hit_rate"))


def _workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workload, policy, capacity, hits, misses of the generated workloads, a task each: capacities in equal entries."""
    made = {"hot set": (traces.hot_set(16, 200, 4, 7), (8, 16, 24, 32)), "domains": (traces.domain_blocks(4, 12, 300, 24, 11), (12, 18, 24, 36, 48)), "skewed": (traces.skewed_layer(64, 20_000, 13), (8, 16, 24, 32))}
    grid = [(w, p, c) for w, (_, cs) in made.items() for c in cs for p in bytecache.POLICIES]

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for w, p, c in zip(b["workload"], b["policy"], b["capacity"], strict=True):
                keys = made[w][0]
                r = bytecache.replay(keys, [4096] * len(keys), int(c) * 4096, p)
                out.append((w, p, c, r["hits"], r["misses"]))
            yield pd.DataFrame(out, columns=["workload", "policy", "capacity", "hits", "misses"])

    return spark.createDataFrame(grid, "workload string, policy string, capacity int").repartition(8).mapInPandas(run, "workload string, policy string, capacity int, hits long, misses long")


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    """The embeddings' trace with labels as subjects."""
    tagged = derive.tagged(spark, sf_dir)
    segments = tagged.groupBy("domain").agg(F.min("token").alias("start"))
    trace = tagged.select("token", "layer", "slot", "expert")
    about = {"source": "derived", "model_id": "embeddings as router scores", "corpus": "a test table"}
    return Analysis(trace, traces.measure(trace, derive.EXPERTS, about), segments, None, derive.layout(spark, sf_dir), window=8)


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.checks(analysis(spark, sf_dir)).select("name", F.round("measured", 6).alias("measured"), "verdict")


def _headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.headline(report.checks(analysis(spark, sf_dir)))


def _other_geometry(spark: SparkSession, sf_dir: str) -> Analysis:
    """A trace of two layers of 32 experts, top 6, from the same scores."""
    at = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("token"), F.posexplode("embedding").alias("p", "score"))
    trace = traces.route(at.selectExpr("token", "cast(p div 32 as int) as layer", "cast(p % 32 as int) as expert", "score"), 6)
    return Analysis(trace, traces.measure(trace, 32), window=8)


def _wide(name: str) -> Query:
    return lambda spark, sf_dir: _other_geometry(spark, sf_dir).query(name)


WIDE_TRACE = """WITH trace AS (SELECT token, layer, slot, expert FROM (SELECT vec_id AS token, (p - 1) // 32 AS layer, (p - 1) % 32 AS expert, row_number() OVER (PARTITION BY vec_id, (p - 1) // 32 ORDER BY embedding[p] DESC, p) - 1 AS slot
  FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS p FROM embeddings)) WHERE slot < 6) """
WIDE_SKEW_SQL = WIDE_TRACE + """, c AS (SELECT layer, e AS expert, (SELECT count(*) FROM trace t WHERE t.layer = g.layer AND t.expert = e) AS n FROM (SELECT DISTINCT layer FROM trace) g, (SELECT unnest(generate_series(0, 31)) AS e)),
p AS (SELECT layer, n / sum(n) OVER (PARTITION BY layer) AS p, rank() OVER (PARTITION BY layer ORDER BY n DESC, expert) AS r FROM c)
SELECT CAST(layer AS INT) AS layer, (SELECT round(sum(abs(x.n - y.n)) / (2 * sum(x.n)), 6) FROM c x, c y WHERE x.layer = p.layer AND y.layer = p.layer) AS gini, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(32), 6) AS entropy, round(sum(p) FILTER (r <= 3), 6) AS decile_mass FROM p GROUP BY layer"""
WIDE_REUSE_SQL = WIDE_TRACE + """, s AS (SELECT layer, token, list(expert) AS own FROM trace GROUP BY layer, token)
SELECT CAST(a.layer AS INT) AS layer, round(avg(len(list_intersect(a.own, b.own)) / 6.0), 6) AS reuse FROM s a JOIN s b ON b.layer = a.layer AND b.token = a.token + 1 GROUP BY a.layer"""

#: Whether a policy hits is told access by access in recursive SQL for small logs only; the tests hold these against plain loops.
OTHERS: dict[str, tuple[Query, str | None]] = {
    "lfu_sweep": (_sweep("lfu"), None),
    "belady_sweep": (_sweep("belady"), None),
    "lru_fold": (lambda spark, sf_dir: _sweep("lru")(spark, sf_dir).select("capacity", "hits"), STATEMENTS["lru_hits_log"]),
    "byte_cache_sweep": (_bytes, None),
    "chain_order": (_chains, None),
    "chain_capture": (_capture, None),
    "capture_ratio_index_order": (_index_capture, CAPTURE_SQL),
    "plan_capped": (_capped, None),
    "linear_probe": (_probe, None),
    "lookahead": (_lookahead, None),
    "probe_widths": (_widths, None),
    "projected_hidden": (_projected, None),
    "tensor_plan": (_tensors, TENSOR_SQL),
    "prefill_output": (_executed(False), EXECUTED_SQL),
    "prefill_by_token": (_executed(True), EXECUTED_SQL),
    "invert_lists": (_lists, LISTS_SQL),
    "schedule_order": (_scheduled, None),
    "call_counts": (_calls, "SELECT layer, expert, CAST(1 AS BIGINT) AS expert_major, count(*) AS rows, count(*) AS token_major FROM {trace} GROUP BY layer, expert"),
    "warm_pass": (_warm, None),
    "corpus_segments": (_corpus, CORPUS_SQL),
    "storage_order": (_placed, PLACED_SQL),
    "storage_totals": (lambda spark, sf_dir: layouts.totals(derive.layout(spark, sf_dir)), "SELECT count(*) AS experts, count(DISTINCT layer) AS layers, CAST(sum(len) AS BIGINT) AS payload_bytes, CAST(sum((len + 4095) // 4096 * 4096) AS BIGINT) AS data_bytes FROM {layout}"),
    "bench_file": (lambda spark, sf_dir: layouts.bench_file(spark), "SELECT CAST(id // 128 AS INT) AS layer, CAST(id % 128 AS INT) AS expert, id AS pos, id * 2097152 AS offset, CAST(2097152 AS BIGINT) AS len FROM (SELECT unnest(generate_series(0, 511)) AS id)"),
    "key_parts": (_keys, "SELECT token * 16 + layer * 4 + slot AS i, layer, expert, CAST(layer AS BIGINT) * 4294967296 + expert AS key FROM {trace}"),
    "entry_scalars": (_sizes, SIZES_SQL),
    "precisions": (lambda spark, sf_dir: scalars.precisions(spark), "SELECT precision, CAST(code AS INT) AS code, CAST(bits AS DOUBLE) AS bits, code > 2 AS needs_dequant FROM (VALUES ('F32', 0, 32.0), ('F16', 1, 16.0), ('BF16', 2, 16.0), ('Q8', 3, 8.5), ('Q6', 4, 6.5), ('Q5', 5, 5.5), ('Q4', 6, 4.5), ('Q3', 7, 3.4), ('Q2', 8, 2.6)) t(precision, code, bits)"),
    "expert_profile": (_profile, PROFILE_SQL),
    "canonical_parts": (_canonical, CANONICAL_SQL),
    "hit_rate_at_target": (_capacity_shares, None),
    "cache_workloads": (_workloads, None),
    "verdicts": (_verdicts, None),
    "headline": (_headline, None),
    "wide_skew": (_wide("skew_by_layer"), WIDE_SKEW_SQL),
    "wide_reuse": (_wide("reuse_by_layer"), WIDE_REUSE_SQL),
    "trace_shape": (lambda spark, sf_dir: _shape(spark, sf_dir), "SELECT max(token) + 1 AS n_tokens, max(layer) + 1 AS n_layers, CAST(16 AS INT) AS n_experts, max(slot) + 1 AS top_k, (max(layer) + 1) * (max(slot) + 1) AS working_set, (max(layer) + 1) * 16 AS total_pairs FROM {trace}"),
}


def _shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = traces.measure(derive.trace(spark, sf_dir), derive.EXPERTS)
    return spark.createDataFrame([(m.n_tokens, m.n_layers, m.n_experts, m.top_k, m.working_set, m.total_pairs)], "n_tokens long, n_layers int, n_experts int, top_k int, working_set int, total_pairs int")


def queries() -> dict[str, Query]:
    return {**{k: _query(v) for k, v in RUN.items()}, **{k: q for k, (q, _) in OTHERS.items()}}


def _standalone(sql: str) -> str:
    needed: list[str] = []
    for n in _names(sql):
        needed += [x for x in [*derive.NEEDS.get(n, []), n] if x not in needed]
    if not needed:
        return sql
    return "WITH " + ", ".join(f"{n} AS ({derive.SQL[n]})" for n in needed) + " " + re.sub(r"\{(\w+)\}", r"\1", sql)


def oracle_sql() -> dict[str, str]:
    return {**{k: _standalone(v) for k, v in STATEMENTS.items()}, **{k: _standalone(v) for k, (_, v) in OTHERS.items() if v}}
