"""Tensor files: their headers as tables, and the byte runs that make up each expert.

A file starts with its header's length (8 bytes, little-endian) and the header, a JSON object of tensors by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest header read.
MOST_HEADER = 64 << 20
# Where expert tensors are named, and bytes of an element.
NAME = r"^model\.layers\.([0-9]+)\.(?:block_sparse_moe|mlp\.experts|feed_forward\.experts)\.(.+)$"
ROUTERS = ("router", "gate")
WIDTH = {"F32": 4, "F16": 2, "BF16": 2, "U8": 1, "I8": 1}
PRECISION = ("F32", "F16", "BF16")


def parse_headers(files: DataFrame) -> DataFrame:
    """path, name, dtype, shape, begin, upto (within the file's data) of files (path, content); content may end with
    the header. Fails on a header that is cut, too long or not JSON, and on a tensor whose bytes don't fit its shape."""
    at = files.select("path", "content", F.conv(F.concat_ws("", *[F.hex(F.substring("content", i, 1)) for i in range(8, 0, -1)]), 16, 10).cast("long").alias("n"))
    bad = (F.length("content") < 8) | F.col("n").isNull() | (F.col("n") > MOST_HEADER) | (F.length("content") < F.col("n") + 8)
    text = F.decode(F.expr("substring(content, 9, cast(n as int))"), "UTF-8")
    at = at.select("path", F.when(bad, F.raise_error(F.concat(F.lit("broken tensor header: "), F.col("path"))).cast("string")).otherwise(text).alias("text"))
    each = at.select("path", F.explode(F.from_json("text", "map<string,string>", {"mode": "FAILFAST"})).alias("name", "t")).where("name <> '__metadata__'")
    t = F.from_json("t", "struct<dtype:string,shape:array<bigint>,data_offsets:array<bigint>>", {"mode": "FAILFAST"})
    each = each.select("path", "name", t.alias("t")).select("path", "name", "t.dtype", "t.shape", F.col("t.data_offsets")[0].alias("begin"), F.col("t.data_offsets")[1].alias("upto"))
    wrong = ~(F.col("upto") - F.col("begin")).eqNullSafe(_bytes())
    return each.withColumn("upto", F.when(wrong, F.raise_error(F.concat(F.lit("tensor bytes do not fit its shape: "), F.col("name"))).cast("long")).otherwise(F.col("upto")))


def _bytes() -> F.Column:
    width = F.coalesce(*[F.when(F.col("dtype") == d, F.lit(w)) for d, w in WIDTH.items()])
    return F.aggregate("shape", width.cast("long"), lambda a, x: a * x)


def expert_parts(tensors: DataFrame) -> DataFrame:
    """layer, expert, projection, name, offset, len: the slice of each stacked tensor (first axis: experts) that belongs
    to each expert, offsets within the tensor; routers, other tensors and those of one axis are left out. Fails where a
    layer's tensors differ in number of experts or in type, or the type has no precision."""
    at = tensors.select("name", "dtype", "shape", F.regexp_extract("name", NAME, 1).alias("layer"), F.regexp_extract("name", NAME, 2).alias("projection"), (F.col("upto") - F.col("begin")).alias("whole"))
    at = at.where((F.col("layer") != "") & (F.size("shape") >= 2) & ~F.split("projection", r"\.")[0].isin(*ROUTERS))
    at = at.select(F.col("layer").cast("int").alias("layer"), "projection", "name", "dtype", "whole", F.col("shape")[0].alias("experts")).where("experts > 0")
    # A layer has a handful of tensors.
    per = at.groupBy("layer").agg(((F.min("experts") != F.max("experts")) | (F.min("dtype") != F.max("dtype")) | ~F.min("dtype").isin(*PRECISION)).alias("bad"))
    at = at.join(per, "layer").withColumn("experts", F.when(F.col("bad"), F.raise_error(F.concat(F.lit("mixed tensors in layer "), F.col("layer").cast("string"))).cast("long")).otherwise(F.col("experts")))
    length = F.expr("whole div experts")
    return at.select("layer", F.explode(F.expr("sequence(0L, experts - 1)")).alias("expert"), "projection", "name", length.alias("len")).select("layer", F.col("expert").cast("int").alias("expert"), "projection", "name", (F.col("expert") * F.col("len")).alias("offset"), "len")
