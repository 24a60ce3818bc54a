"""Connected components and near-duplicate linking on DataFrames, without collecting nodes, links or groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, release, settle

#: Rounds double the reach of a label, so this bounds paths longer than any table has rows.
MOST_ROUNDS = 60
#: Links a task of a round takes at least: small graphs are not cut into more files than they have use for.
ROUND_ROWS = 100_000
#: Links from which on a round is written in steps.
APART = 1_000_000
#: Members of a mixed bucket that are compared within it; members of larger ones meet by prefixes.
SMALL = 32
#: Prefixes of up to so many shingles travel with each of them, so that a pair comes from its first common one alone.
SHORT = 128


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the graph with links (a, b); component is the smallest node reachable.

    Distributed union-find by alternating star contraction: each round points the neighbours of a node at the smallest
    of them (large star, then small star). Rows stay within twice the links, and rounds grow with the logarithm of the
    longest path. Each round is written to the shared folder. Of graphs of up to ROUND_ROWS links a round is one task,
    without a shuffle. In graphs of over APART links, what a round joins is written too, so that both sides of a join are
    plain shuffles, and a node with very many links can be split among tasks."""
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    digest, rows = None, edges.count()
    for _ in range(MOST_ROUNDS):
        few = -(-rows // ROUND_ROWS) or 1
        step = settle if rows > APART else lambda x: x
        edges, before = edges.coalesce(1) if few == 1 else edges, edges
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = step(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.where("m < u").select("u", F.col("m").alias("v")))
        large = step((large.coalesce(1) if few == 1 else large).distinct())
        down = step(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(down.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = settle((small.coalesce(1) if few == 1 else small).distinct().coalesce(few))
        release(before, *([low, large, down] if rows > APART else []))
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38,0)))")).first()
        if now == digest:
            break
        digest, rows = now, now[0]
    else:
        raise RuntimeError(f"components have not settled after {MOST_ROUNDS} rounds")
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def crowded(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the keys that two ids or more share among members (key, id, copies): (a, b) of those with two members, a < b, and
    key, id, pivot, many of the others. copies of a member that comes several times are added up. pivot is the most copied
    member (then the smallest id), many their number. members are read twice: they are to be cheap to make from a settled table.

    Most keys have one member, and most of the others two, which the least and the greatest id of a key's rows are: only
    members of larger keys are read again. Both tables are settled."""
    keys = settle(members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high"))
    two = settle(keys.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).distinct())
    at = settle(among(members, keys.where("n > 2"), "key").groupBy("key", "id").agg(F.sum("copies").alias("copies")))
    release(keys)
    groups = settle(at.groupBy("key").agg(F.min(F.struct(-F.col("copies"), F.col("id")))["id"].alias("pivot"), F.count("*").alias("many")))
    out = settle(at.join(groups, "key"))
    release(at, groups)
    return two, out


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of found, a settled table, with further links (a, b). Only the graph of components is searched."""
    for side in "ab":
        links = links.join(found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
    links = links.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = settle(components(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
    of = moved.select(F.col("node").alias("component"), F.col("component").alias("now"))
    whole = found.join(of, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    out = settle(whole.union(moved.join(found.select("node"), "node", "left_anti")))
    release(moved)
    return out


Info = Callable[[DataFrame], DataFrame]


def link_buckets(members: DataFrame, verify: Callable[[DataFrame], DataFrame], info: Info, near: str, prefixes: Info, closer: tuple[Info, str] | None = None, own: bool = False) -> DataFrame:
    """(node, component) over the verified links among members (key, id, copies) that share a key.

    First each bucket's pivot is compared with the others of its bucket: as many pairs as members, whatever the bucket's
    size, around the text that most others were edited from. Buckets whose members then lie in one component are done:
    no further link could change anything. In the others, every member outside the bucket's largest component is
    compared with the members of other components that near lets through: SQL over the columns that info gives for ids
    (id, ...), prefixed x_ and y_. Buckets of up to SMALL members are compared within themselves; members of larger ones
    meet where their prefixes do: (id, shingle) such that linked ids have a shingle in common. There too, one member of a
    shingle is compared with the others first, and all pairs only where components still differ. So no bucket is capped, and
    no link between components is lost that near lets through. verify takes pairs (a, b), a < b, and returns the links.
    closer: another info and near for the members of large buckets, where more pairs are near to the bound. own: the settled
    tables that members are read from are deleted once the buckets are known."""
    two, crowd = crowded(members)
    if own:
        release(members)
    star = crowd.where("id <> pivot").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b"))
    found = settle(components(verify(two.union(star).distinct())))
    at = crowd.where("many > 2").select("key", "id", "many").join(found.withColumnRenamed("node", "id"), "id", "left")
    at = settle(at.select("key", "id", "many", F.coalesce("component", "id").alias("component")))
    parts = at.groupBy("key", "component").agg(F.count("*").alias("m"))
    mixed = settle(parts.groupBy("key").agg(F.max(F.struct("m", "component"))["component"].alias("major"), F.count("*").alias("parts")).where("parts > 1"))
    at = settle(at.join(mixed.select("key", "major"), "key").withColumn("minor", F.expr("component <> major")).drop("major"))
    release(two, crowd, mixed)
    if not at.limit(1).count():
        release(at)
        return found
    held = settle(info((at.where(F.col("many") <= SMALL) if closer else at).select("id").distinct()))
    columns = [c for c in held.columns if c != "id"]
    rows = settle(at.join(held, "id"))
    sides = lambda rows, by: (
        rows.where("minor").select(by, "id", "component", *[F.col(c).alias(f"x_{c}") for c in columns]),
        rows.select(F.col(by).alias("same"), F.col("id").alias("other"), F.col("component").alias("their"), *[F.col(c).alias(f"y_{c}") for c in columns]),
    )
    ends = (F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    x, y = sides(rows.where(F.col("many") <= SMALL), "key")
    pairs = x.join(y, (x["key"] == y["same"]) & F.expr(f"component <> their and ({near})")).select(*ends)
    large = settle((at if closer else rows).where(F.col("many") > SMALL).groupBy("id", "component", *([] if closer else columns)).agg(F.max("minor").alias("minor")))
    some = large.limit(1).count()
    if some and closer:
        before, near = large, closer[1]
        large = settle(large.join(closer[0](large.select("id")), "id"))
        columns = [c for c in large.columns if c not in ("id", "component", "minor")]
        release(before)
    if some:
        first = settle(prefixes(large.select("id")))
        meet = settle(large.join(first, "id"))
        # As with buckets, one member of each shingle is compared with the others first: as many pairs as members.
        lone = meet.groupBy("shingle").agg(F.min_by(F.struct("id", "component", *columns), F.xxhash64("id")).alias("p"))
        lone = lone.select("shingle", F.col("p.id").alias("other"), F.col("p.component").alias("their"), *[F.col(f"p.{c}").alias(f"y_{c}") for c in columns])
        x = meet.select("shingle", "id", "component", *[F.col(c).alias(f"x_{c}") for c in columns])
        pairs = pairs.union(x.join(lone, "shingle").where(f"component <> their and ({near})").select(*ends))
    out = merged(found, verify(pairs.distinct()))
    if some:
        now = settle(meet.drop("component").join(out.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
        # Only shingles of several components can still bring a link.
        differing = settle(now.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle"))
        whole = first.groupBy("id").agg(F.count("*").alias("k"), F.collect_list(F.col("shingle")).alias("p")).select("id", F.expr(f"if(k <= {SHORT}, p, null)").alias("p"))
        columns.append("p")
        x, y = sides(settle(among(now, differing, "shingle").join(whole, "id")), "shingle")
        once = "coalesce(shingle = array_min(array_intersect(x_p, y_p)), true)"
        pairs = x.join(y, (x["shingle"] == y["same"]) & F.expr(f"component <> their and ({near}) and {once}")).select(*ends)
        before, out = out, merged(out, verify(pairs.distinct()))
        release(before, first, meet, now, differing)
    release(at, found, held, rows, large)
    return out
