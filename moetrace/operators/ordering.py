"""Storage order of a layer's experts from its co-activation edges, and capped read plans.

Orders are built a layer to a task: a layer has as many rows as experts and kept edges, whatever the trace's length."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
GAP, CAP = 1 << 20, 32 << 20


def chain_order(experts: Iterable[int], edges: Iterable[tuple[int, int, float]]) -> list[int]:
    """Experts in order: the heaviest edges first (ties: the smaller pair), an edge joins two chains where both its
    experts are ends, the first expert's chain in front. The chains follow each other by their first expert."""
    chain = {e: [e] for e in experts}
    for a, b, _ in sorted(edges, key=lambda x: (-x[2], x[0], x[1])):
        front, back = chain.get(a), chain.get(b)
        if front is None or back is None or front is back:
            continue
        if front[-1] != a:
            if front[0] != a:
                continue
            front.reverse()
        if back[0] != b:
            if back[-1] != b:
                continue
            back.reverse()
        front += back
        chain.update(dict.fromkeys(back, front))
    whole = {id(c): c for c in chain.values()}
    return [e for c in sorted(whole.values(), key=lambda c: c[0]) for e in c]


def order_layers(experts: DataFrame, edges: DataFrame) -> DataFrame:
    """(layer, expert, place) from experts (layer, expert) and edges (layer, a, b, weight)."""

    def run(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        order = chain_order(sorted(own["expert"].tolist()), zip(links["a"], links["b"], links["weight"], strict=True))
        return pd.DataFrame({"layer": own["layer"].iloc[:1].repeat(len(order)).to_numpy() if len(own) else [], "expert": order, "place": range(len(order))})

    at = experts.select("layer", "expert").distinct().groupBy("layer").cogroup(edges.select("layer", "a", "b", "weight").groupBy("layer"))
    return at.applyInPandas(run, "layer int, expert int, place int")


def capture_ratio(order: DataFrame, edges: DataFrame, window: int) -> DataFrame:
    """layer, captured: the share of edge weight between experts whose gap on disk is at most window bytes: from the end of
    the earlier one's blocks to the start of the later one. order (layer, expert, place, len); 0 for a layer without weight."""
    padded = (F.ceil(F.col("len") / BLOCK) * BLOCK).cast("long")
    at = order.withColumn("upto", F.sum(padded).over(Window.partitionBy("layer").orderBy("place"))).select("layer", "expert", (F.col("upto") - padded).alias("off"), "upto")
    both = edges.select("layer", "a", "b", "weight")
    for side in "ab":
        both = both.join(at.select("layer", F.col("expert").alias(side), F.col("off").alias(f"off_{side}"), F.col("upto").alias(f"upto_{side}")), ["layer", side])
    gap = F.greatest("off_a", "off_b") - F.least("upto_a", "upto_b")
    share = F.sum(F.when(gap <= window, F.col("weight")).otherwise(0.0)) / F.nullif(F.sum("weight"), F.lit(0.0))
    return both.groupBy("layer").agg(F.round(F.coalesce(share, F.lit(0.0)), 6).alias("captured"))


def is_permutation(order: DataFrame, experts: DataFrame) -> bool:
    """Whether an order has each expert (layer, expert) once."""
    a, b = order.select("layer", "expert"), experts.select("layer", "expert")
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def profile(trace: DataFrame, declared: DataFrame) -> DataFrame:
    """layer, expert, hits, tokens: how often each expert is used and how many tokens its layer has seen; declared experts
    (layer, expert) that never were are there with 0, and so are used ones that were not declared."""
    hits = trace.groupBy("layer", "expert").agg(F.countDistinct("token").alias("hits"))
    tokens = trace.groupBy("layer").agg(F.countDistinct("token").alias("tokens"))
    every = declared.select("layer", "expert").union(hits.select("layer", "expert")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(hits, ["layer", "expert"], "left").join(tokens, "layer", "left").select("layer", "expert", zero("hits"), zero("tokens"))


def capped_plan(wants: DataFrame, by: list[str], gap: int = GAP, cap: int = CAP, coalesce: bool = True) -> DataFrame:
    """Transfers of each want set (by..., off, len): from the left, an entry joins the open transfer if the gap between
    them is at most gap and the transfer stays within cap bytes; an entry larger than cap goes alone. Lengths are padded
    to blocks. Returns by..., req (from 0), file_offset, span, wanted, experts."""
    padded = F.ceil(F.col("len") / BLOCK) * BLOCK
    sets = wants.select(*by, F.struct("off", padded.cast("long").alias("len")).alias("e")).groupBy(*by).agg(F.sort_array(F.collect_set("e")).alias("es"))
    kind = "array<struct<file_offset:bigint,span:bigint,wanted:bigint,experts:bigint>>"
    last = "element_at(acc, -1)"
    joins = f"{str(coalesce).lower()} and size(acc) > 0 and x.off - ({last}.file_offset + {last}.span) <= {gap} and x.off + x.len - {last}.file_offset <= {cap}"
    grown = f"named_struct('file_offset', {last}.file_offset, 'span', x.off + x.len - {last}.file_offset, 'wanted', {last}.wanted + x.len, 'experts', {last}.experts + 1L)"
    alone = "named_struct('file_offset', x.off, 'span', x.len, 'wanted', x.len, 'experts', 1L)"
    # element_at fails on an empty array, so the first entry opens the first transfer.
    fold = f"aggregate(slice(es, 2, size(es)), cast(transform(slice(es, 1, 1), x -> {alone}) as {kind}), (acc, x) -> cast(if({joins}, concat(slice(acc, 1, size(acc) - 1), array({grown})), concat(acc, array({alone}))) as {kind}))"
    return sets.select(*by, F.posexplode(F.expr(fold)).alias("req", "r")).select(*by, F.col("req").cast("long").alias("req"), "r.file_offset", "r.span", "r.wanted", "r.experts")
