"""Line dedup: near-equal lines by MinHash over character shingles, one line kept per component.

Lines are compared lower-cased. A line's set is its shingles of 12 characters at all positions; a line shorter than 12 is
its only shingle. The shingles' 32-bit hashes fall into 16 sectors; from each sector's start the nearest hash of the set
is taken (one of a near sector, where this one is empty), and two of these make a bucket key: sets of Jaccard 0.8 share
one of the 8 keys with probability 0.9997, of 0.85 with 0.99996. Lines that share a bucket are verified by the exact Jaccard
of their whole sets, and a distributed union-find joins them; the first line of a component in (doc_id, position) order
stays, all others go. Only DataFrame functions are used.

Defined results: empty and blank lines (white space only) stay and are never compared; equal lines are one line from the
start; a null text stays null; rows that share doc_id and text are one document, and each gets that document's result; a
null doc_id comes after all others; line breaks are U+000A. Other columns of docs are kept; columns named n_lines and
n_removed are replaced. Lines are told apart by two hashes of 96 bits together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import among, release, settle
from .graph import link_buckets

PERCENT = 80
#: Sectors, and hashes in a key.
SECTORS, TAKEN = 16, 2
#: Positions for each sector from which on far hashes are first left out.
AMPLE = 7
#: White space, as in the regular expression \\s: a match of each line with \\S costs more than to strip its beginning.
BLANK = " \t\n\x0b\f\r"
#: Longs of a sketch.
LONGS = 16
#: Shingles of a line that are drawn to find its links within a large bucket, and which percentage of its rarest counts.
DRAWN, RAREST = 80, 50


# Characters of four bytes each: a shingle is cut out without a walk through the line. Bytes where shingles begin:
STARTS = "sequence(1, greatest(octet_length(u) - 47, 1), 4)"
SHINGLE = "xxhash64(substring(u, i, 48))"


def _hashes(line: str) -> str:
    """SQL for the distinct shingles at all positions of a lower-cased line, as 64-bit hashes."""
    return f"array_distinct(transform(array(encode({line}, 'UTF-32')), u -> transform({STARTS}, i -> {SHINGLE}))[0])"


def _nearest(lines: DataFrame, most: int) -> DataFrame:
    """_id, n, copies, and of each sector the nearest hash m0, m1, ... over the shingles at all positions of lines (_id, _line). In
    lines of more than `most` shingles, only the first and those so near to their sector's start that about `most` are left."""
    at = lines.select("_id", F.encode("_line", "UTF-32").alias("u")).withColumn("n", F.expr("greatest(octet_length(u) div 4 - 11, 1)"))
    at = at.withColumn("near", F.expr(f"cast(least(({most * 2**28}L + n - 1) div n, {2**28}L) as int)"))
    # Row numbers are never below 0: they keep the condition from going below this step, where hashes would be made twice.
    once = F.expr(f"if(monotonically_increasing_id() < 0, 0, cast({SHINGLE} >> 32 as int))").alias("h")
    at = at.select("_id", "u", "n", "near", F.explode(F.expr(STARTS)).alias("i")).select("_id", "n", "near", "i", once)
    at = at.where(f"i = 1 or (h & {2**28 - 1}) < near")
    return at.groupBy("_id").agg(F.max("n").alias("n"), F.expr("count_if(i = 1)").alias("copies"), *[F.expr(f"min(h ^ shiftleft({i}, 28))").alias(f"m{i}") for i in range(SECTORS)])


def _signed(lines: DataFrame) -> DataFrame:
    """_id, copies and nearest hashes m0, m1, ... of every line of lines (_id, _line), a settled table. Where far hashes were
    left out and a sector has no near one, the line is signed anew with all its hashes, so they are always those of the whole set."""
    most = AMPLE * SECTORS
    # In its own sector, the nearest hash is so far above the least int.
    sure = " and ".join(f"(m{i} + {2**31}L) * n < {most * 2**28}L" for i in range(SECTORS))
    near = settle(_nearest(lines, most).withColumn("sure", F.expr(f"n <= {most} or ({sure})")))
    unsure = settle(near.where("not sure").select("_id"))
    again = settle(_nearest(among(lines.select("_id", "_line"), unsure, "_id"), 2**31 - 1))
    own = ["_id", "copies", *[f"m{i}" for i in range(SECTORS)]]
    release(unsure)
    return near.where("sure").select(own).union(again.select(own))


def _lines(docs: DataFrame) -> DataFrame:
    at = docs.select("doc_id", F.xxhash64("text").alias("_t"), F.posexplode(F.split("text", "\n", -1)).alias("_pos", "_raw"))
    at = at.where(F.ltrim("_raw", F.lit(BLANK)) != "").select("doc_id", "_t", "_pos", F.lower("_raw").alias("_line"))
    return at.select("doc_id", "_t", "_pos", "_line", F.xxhash64("_line").alias("_id"), F.hash("_line").alias("_id2"))


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, _t (hash of the text) and gone: the positions of the lines that go, for documents that lose any."""
    docs = docs.select("doc_id", "text").where("text is not null")
    seen = settle(_lines(docs))
    signed = _signed(seen)
    twice = settle(signed.where("copies > 1").select("_id"))
    keys = F.array(*[F.xxhash64(F.lit(i), *[f"m{i + j}" for j in range(TAKEN)]) for i in range(0, SECTORS, TAKEN)])
    members = signed.select("_id", F.explode(keys).alias("key")).select("key", F.col("_id").alias("id"), F.lit(1).alias("copies"))
    held: list[DataFrame] = []
    places: list[DataFrame] = []
    apart = lambda c: " + ".join(f"bit_count(x_{c}{i} ^ y_{c}{i})" for i in range(LONGS))
    few = lambda c: f"{100 + percent} * ({apart(c)}) <= {100 - percent} * (x_n + y_n)"
    bit = lambda i: f"if((h & {64 * LONGS - 64}) = {64 * i}, shiftleft(1L, cast(h & 63 as int)), 0L)"
    listed: list[DataFrame] = []

    def filled(lines: DataFrame) -> DataFrame:
        """Numbers of positions, and which slots the hashes fill: of sets that differ in d elements, d slots at most differ.
        In generated code: repeated shingles need not be found."""
        each = lines.repartition("id").select("id", F.encode("_line", "UTF-32").alias("u")).select("id", "u", F.explode(F.expr(STARTS)).alias("i"))
        each = each.select("id", F.expr(SHINGLE).alias("h"))
        return each.groupBy("id").agg(F.count("*").alias("n"), *[F.expr(f"bit_or({bit(i)})").alias(f"f{i}") for i in range(LONGS)])

    def shingles(ids: DataFrame) -> DataFrame:
        sets = among(held[0], ids, "id").select("id", F.expr(_hashes("_line")).alias("s")).select("id", "s", F.size("s").alias("size"))
        return settle(sets.select("id", "size", F.explode("s").alias("shingle")))

    def about(ids: DataFrame) -> DataFrame:
        """Sizes of the sets, and odd sketches: where they differ in d bits, the sets differ in d elements at least."""
        listed.append(shingles(ids))
        each = listed[0].select("id", F.col("shingle").alias("h"))
        return each.groupBy("id").agg(F.count("*").alias("n"), *[F.expr(f"bit_xor({bit(i)})").alias(f"o{i}") for i in range(LONGS)])

    near = f"least(x_n, y_n) * 100 >= {percent} * greatest(x_n, y_n) and {few('o')}"

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs)
        if not held:  # the first pairs are of all lines that are ever compared
            ids = settle(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct())
            held.append(settle(among(seen.select("_id", "_line"), ids, "_id").groupBy(F.col("_id").alias("id")).agg(F.first("_line").alias("_line"))))
            held.append(settle(filled(held[0])))
            for side, name in zip("ab", "xy", strict=True):
                pairs = pairs.join(held[1].select(F.col("id").alias(side), *[F.col(c).alias(f"{name}_{c}") for c in held[1].columns if c != "id"]), side)
            pairs = settle(pairs.where(few("f")).select("a", "b"))
            # From now on no other line's text is read.
            places.append(settle(seen.drop("_line")))
            release(ids, seen)
        # Sets of the first ends are made once, as many pairs have one. Of the others lines travel, which take an eighth of the room.
        ids = settle(pairs.select(F.col("a").alias("id")).distinct())
        sets = among(held[0], ids, "id").select(F.col("id").alias("a"), F.expr(_hashes("_line")).alias("x"))
        pairs = pairs.join(held[0].select(F.col("id").alias("b"), "_line"), "b").join(sets.hint("merge"), "a")
        # Behind explode the other set is made once for all of the condition, which then is generated code.
        pairs = pairs.select("a", "b", "x", F.explode(F.array(F.expr(_hashes("_line")))).alias("y"))
        return pairs.where(f"{100 + percent}L * size(array_intersect(x, y)) >= {percent}L * (size(x) + size(y))").select("a", "b").distinct()

    def prefixes(ids: DataFrame) -> DataFrame:
        """Of each line's shingles those whose hash is so low that about DRAWN remain, all of them in lines of fewer; of
        these the rarer half, counted among the lines compared. Linked sets share four fifths of what is drawn of either at
        least, on average: their rarer halves have the first common one, unless more was drawn that they do not share, which
        has a probability below 3e-8."""
        at = listed[0] if listed else shingles(ids)
        drawn = at.where(f"size <= {DRAWN} or (shingle & {2**31 - 1}L) * size < {DRAWN * 2**31}L").select("id", "shingle")
        often = drawn.groupBy("shingle").agg(F.count("*").alias("n"))
        # By a window, which sorts plain rows instead of making lists of them; one order for both columns, so that they are sorted once.
        order = Window.partitionBy("id").orderBy("n", "shingle")
        size = F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("size")
        rarest = drawn.join(often, "shingle").select("id", "shingle", "n", size, F.row_number().over(order).alias("rank"))
        rarest = rarest.where(f"rank <= ceil({RAREST} * size / 100) + 1")
        # A shingle of one line alone is shared with none.
        out = settle(rarest.where("n > 1").select("id", "shingle"))
        release(at)
        return out

    # One node for the lines of each _id; a key of a line with few shingles is its whole set.
    found = link_buckets(members, verify, lambda ids: among(held[1], settle(ids), "id"), few("f"), prefixes, (about, near), True)
    release(*held)
    seen = places[0]
    # Only lines that are there twice or have links can go.
    doubtful = settle(twice.union(found.select(F.col("node").alias("_id"))).distinct())
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_t", "_pos")
    at = settle(among(seen.select("_id", "_id2", place.alias("_place")), doubtful, "_id"))
    at = at.join(found.select(F.col("node").alias("_id"), "component"), "_id", "left")
    # Partial results first: a line of any number of copies is a row a task.
    first = at.groupBy(F.coalesce("component", "_id"), F.when(F.col("component").isNull(), F.col("_id2"))).agg(F.min("_place").alias("_place"))
    both = at.select("_place", F.lit(False).alias("stays")).union(first.select("_place", F.lit(True)))
    of = lambda stays: F.collect_set(F.when(F.col("stays") == stays, F.col("_place._pos")))
    both = both.groupBy(F.col("_place.doc_id").alias("doc_id"), F.col("_place._t").alias("_t")).agg(F.array_except(of(False), of(True)).alias("gone"))
    gone = settle(both.where("size(gone) > 0"))
    release(seen, twice, found, doubtful, at)
    return gone


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with the lines that go taken out of text, and n_lines and n_removed: the line breaks of what stays stay."""
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = removed_lines(docs, percent).select(F.col("doc_id").alias("_moetrace_id"), F.col("_t").alias("_moetrace_t"), F.col("gone").alias("_moetrace_gone"))
    at = docs.select(others).join(gone, F.col("doc_id").eqNullSafe(F.col("_moetrace_id")) & (F.xxhash64("text") == F.col("_moetrace_t")), "left")
    # Split once.
    left = "array_join(transform(array_except(sequence(0, size(x.l) - 1), x.g), i -> get(x.l, i)), '\\n')"
    parts = f"""transform(array(struct(split(text, '\\n', -1) as l, coalesce(_moetrace_gone, array()) as g)),
      x -> struct(if(size(x.g) = 0, null, {left}) as left, cast(size(x.l) as bigint) as n_lines, cast(size(x.g) as bigint) as n_removed))[0]"""
    at = at.withColumn("_moetrace_out", F.when(F.col("text").isNotNull(), F.expr(parts)))
    text = F.coalesce("_moetrace_out.left", "text").alias("text")
    counts = [F.coalesce(f"_moetrace_out.{c}", F.lit(0)).cast("long").alias(c) for c in ("n_lines", "n_removed")]
    return at.select(*[text if c == "text" else F.col(c) for c in others], *counts)
