"""Routing traces, access logs, baskets and layouts derived from the stored tables.

Each relation has a DataFrame and, for checks in another engine, SQL. A trace has columns token, layer, slot, expert:
the four largest of sixteen scores of each layer, ties to the smaller expert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAYERS, EXPERTS, TOP = 4, 16, 4


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token"), "label", F.posexplode("embedding").alias("pos", "score"))
    return at.select("token", "label", F.expr("cast(pos div 16 as int)").alias("layer"), F.expr("cast(pos % 16 as int)").alias("expert"), "score")


def hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, layer, h: the scores of a layer as its hidden state."""
    at = F.posexplode(F.expr("transform(sequence(0, 3), l -> cast(slice(embedding, 16 * l + 1, 16) as array<double>))")).alias("layer", "h")
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token"), at)


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A token's scores come from one row, so its four best are picked there, without a shuffle.
    best = "transform(slice(sort_array(transform(slice(embedding, 16 * l + 1, 16), (x, e) -> struct(-x as s, e as e))), 1, 4), x -> x.e)"
    at = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token"), F.posexplode(F.expr(f"transform(sequence(0, 3), l -> {best})")).alias("layer", "own"))
    return at.select("token", "layer", F.posexplode("own").alias("slot", "expert"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace with tokens numbered label by label; domain is the label."""
    order = _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    sizes = order.groupBy("label").agg(F.count("*").alias("n"))
    before = sizes.select("label", F.coalesce(F.sum("n").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    at = order.join(F.broadcast(before), "label").withColumn("pos", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    at = at.select(F.col("vec_id").alias("token"), F.col("label").alias("domain"), "start", F.col("pos").cast("long").alias("pos"))
    return trace(spark, sf_dir).join(at, "token").select("domain", "start", "pos", (F.col("start") + F.col("pos")).alias("token"), "layer", "slot", "expert")


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, key) in order; the trace is dense, so places need no global sort."""
    at = trace(spark, sf_dir)
    return at.select((F.col("token") * (LAYERS * TOP) + F.col("layer") * TOP + F.col("slot")).alias("i"), F.expr("shiftleft(cast(layer as bigint), 32) | expert").alias("key"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "case event_type when 'click' then 0L when 'error' then 1L when 'purchase' then 2L when 'signup' then 3L else 4L end"
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.expr(f"{kind} * 4294967296 + user_id % 32").alias("key"))


def gaps(spark: SparkSession, sf_dir: str, of: str = "accesses") -> DataFrame:
    """(i, j): the accesses j strictly between an access i and the one before of its key."""
    at = globals()[of](spark, sf_dir)
    before = at.withColumn("prev", F.lag("i").over(Window.partitionBy("key").orderBy("i"))).where("i - prev > 1")
    return before.select("i", F.explode(F.expr("sequence(prev + 1, i - 1)")).alias("j"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("token"), (F.col("l_suppkey") % 64).cast("int").alias("expert")).distinct()


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layer, expert, pos, len: the grid in index order."""
    at = spark.range(LAYERS * EXPERTS).select((F.col("id") / EXPERTS).cast("int").alias("layer"), (F.col("id") % EXPERTS).cast("int").alias("expert"), F.col("id").alias("pos"))
    return at.withColumn("len", F.expr("cast(1000 + (expert * 7919L + layer * 104729L) % 60000 as bigint)"))


def place_wants(chosen: DataFrame, layout: DataFrame) -> DataFrame:
    """token, layer, off, len of the distinct experts chosen (token, layer, expert); fails where the layout (layer, expert,
    pos, len) lacks one."""
    padded = F.expr("cast((len + 4095) div 4096 * 4096 as bigint)")
    # The layout is as long as the model has experts, whatever the trace's length.
    at = layout.withColumn("off", F.sum(padded).over(Window.orderBy("pos")) - padded).select("layer", "expert", "off", "len")
    at = chosen.select("token", "layer", "expert").distinct().join(at, ["layer", "expert"], "left")
    gone = F.raise_error(F.concat_ws(" ", F.lit("not in the layout: layer"), F.col("layer").cast("string"), F.lit("expert"), F.col("expert").cast("string"))).cast("long")
    return at.select("token", "layer", F.when(F.col("off").isNull(), gone).otherwise(F.col("off")).alias("off"), "len")


def wants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_wants(trace(spark, sf_dir), layout(spark, sf_dir))


#: The same relations in SQL of the checking engine.
SQL = {
    "trace": """SELECT token, layer, CAST(row_number() OVER (PARTITION BY token, layer ORDER BY score DESC, expert) - 1 AS INT) AS slot, expert FROM (
        SELECT vec_id AS token, CAST((p - 1) // 16 AS INT) AS layer, CAST((p - 1) % 16 AS INT) AS expert, embedding[p] AS score
        FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS p FROM embeddings)) QUALIFY slot < 4""",
    "tagged": """SELECT o.domain, o.start, o.pos, o.start + o.pos AS token, t.layer, t.slot, t.expert FROM trace t JOIN (
        SELECT vec_id, label AS domain, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
               (SELECT count(*) FROM embeddings x WHERE x.label < e.label) AS start FROM embeddings e) o ON o.vec_id = t.token""",
    "accesses": "SELECT token * 16 + layer * 4 + slot AS i, CAST(layer AS BIGINT) * 4294967296 + expert AS key FROM trace",
    "log": "SELECT event_id AS i, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END * 4294967296 + user_id % 32 AS key FROM events",
    "gaps": "SELECT i, unnest(generate_series(prev + 1, i - 1)) AS j FROM (SELECT i, lag(i) OVER (PARTITION BY key ORDER BY i) AS prev FROM accesses) WHERE i - prev > 1",
    "log_gaps": "SELECT i, unnest(generate_series(prev + 1, i - 1)) AS j FROM (SELECT i, lag(i) OVER (PARTITION BY key ORDER BY i) AS prev FROM log) WHERE i - prev > 1",
    "baskets": "SELECT DISTINCT l_orderkey AS token, CAST(l_suppkey % 64 AS INT) AS expert FROM lineitem",
    "layout": "SELECT CAST(id // 16 AS INT) AS layer, CAST(id % 16 AS INT) AS expert, id AS pos, CAST(1000 + ((id % 16) * 7919 + (id // 16) * 104729) % 60000 AS BIGINT) AS len FROM (SELECT unnest(generate_series(0, 63)) AS id)",
    "wants": """SELECT DISTINCT t.token, t.layer, o.off, o.len FROM trace t JOIN (
        SELECT layer, expert, len, CAST(sum((len + 4095) // 4096 * 4096) OVER (ORDER BY pos) - (len + 4095) // 4096 * 4096 AS BIGINT) AS off FROM layout) o ON o.layer = t.layer AND o.expert = t.expert""",
}
NEEDS = {"wants": ["trace", "layout"], "tagged": ["trace"], "accesses": ["trace"], "gaps": ["trace", "accesses"], "log_gaps": ["log"]}
BUILD = {"trace": trace, "tagged": tagged, "accesses": accesses, "log": log, "gaps": gaps, "log_gaps": lambda s, d: gaps(s, d, "log"), "baskets": baskets, "layout": layout, "wants": wants}
