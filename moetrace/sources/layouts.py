"""Expert storage: layout tables, layout files, and conversion from tensor files.

A layout is a table layer, expert, pos, offset, len, precision, crc32 with payloads beside it (layer, expert, payload).
A layout file is a header block, the model's name, the index (entries, then co-activation edges) and the payloads, each
from a multiple of 4096 bytes on; numbers are little-endian, and header, index and payloads carry CRC-32 checksums."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import PRECISIONS, align_up

BLOCK, HEADER, VERSION = 4096, 128, 1
#: Begins this engine's files; files of another origin may begin with another mark of eight bytes.
MARK = b"MOELAYT\0"
HEAD = struct.Struct("<8sIIIIQQIIQQII")
ENTRY = np.dtype([("layer", "<u4"), ("expert", "<u4"), ("offset", "<u8"), ("len", "<u8"), ("precision", "u1"), ("pad", "V3"), ("crc32", "<u4")])
EDGE = np.dtype([("layer", "<u4"), ("a", "<u4"), ("b", "<u4"), ("weight", "<f4")])
CODE = {name: code for name, code, _ in PRECISIONS}
NAME = {code: name for name, code, _ in PRECISIONS}


def _up(n: int) -> int:
    return -(-n // BLOCK) * BLOCK


def lay_out(payloads: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """layer, expert, pos, offset, len, precision, crc32 of payloads (layer, expert, precision, payload), in the order
    (layer, expert, place) where one is given: layer by layer, experts without a place last by index. Fails where an expert
    comes twice."""
    at = payloads.select("layer", "expert", "precision", F.length("payload").cast("long").alias("len"), F.crc32("payload").alias("crc32"))
    many = F.count("*").over(Window.partitionBy("layer", "expert"))
    twice = F.raise_error(F.concat_ws(" ", F.lit("twice in the layout: layer"), F.col("layer").cast("string"), F.lit("expert"), F.col("expert").cast("string"))).cast("long")
    at = at.withColumn("_many", many).withColumn("len", F.when(F.col("_many") > 1, twice).otherwise(F.col("len"))).drop("_many")
    return place(reorder(at, order) if order is not None else at.withColumn("place", F.lit(None).cast("long")))


def reorder(entries: DataFrame, order: DataFrame) -> DataFrame:
    """entries with place from the order (layer, expert, place), null where it has none."""
    return entries.join(order.select("layer", "expert", F.col("place").cast("long").alias("place")), ["layer", "expert"], "left")


def place(entries: DataFrame) -> DataFrame:
    """pos and offset of entries (layer, expert, place, len, ...): layers ascending, then place, nulls last, then expert.
    As many rows as the model has experts, so one task numbers them."""
    order = Window.orderBy("layer", F.col("place").asc_nulls_last(), "expert")
    before = F.sum(align_up(F.col("len"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    at = entries.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))
    return at.drop("place")


def totals(layout: DataFrame) -> DataFrame:
    """experts, layers, payload_bytes (no padding), data_bytes (padded)."""
    return layout.agg(F.count("*").alias("experts"), F.countDistinct("layer").alias("layers"), F.sum("len").alias("payload_bytes"), F.sum(align_up(F.col("len"))).alias("data_bytes"))


def encode_header(n_layers: int, n_entries: int, index_at: int, index: bytes, data_at: int, data_len: int, name_len: int, n_edges: int, mark: bytes = MARK) -> bytes:
    head = HEAD.pack(mark, VERSION, 0, n_layers, n_entries, index_at, len(index), zlib.crc32(index), BLOCK, data_at, data_len, name_len, n_edges)
    return (head + struct.pack("<I", zlib.crc32(head))).ljust(HEADER, b"\0")


def decode_header(raw: bytes, mark: bytes = MARK) -> dict[str, int]:
    if len(raw) < HEADER:
        raise ValueError("the file ends inside its header")
    own, version, _, n_layers, n_entries, index_at, index_len, index_crc, block, data_at, data_len, name_len, n_edges = HEAD.unpack_from(raw)
    if own != mark:
        raise ValueError(f"not a layout file: begins with {own!r}")
    if struct.unpack_from("<I", raw, HEAD.size)[0] != zlib.crc32(raw[: HEAD.size]):
        raise ValueError("corrupt header")
    if version != VERSION or block != BLOCK:
        raise ValueError(f"version {version} with blocks of {block}, not {VERSION} with {BLOCK}")
    return {"n_layers": n_layers, "n_entries": n_entries, "index_at": index_at, "index_len": index_len, "index_crc": index_crc, "data_at": data_at, "data_len": data_len, "name_len": name_len, "n_edges": n_edges}


def encode_index(entries: np.ndarray, edges: np.ndarray) -> bytes:
    return struct.pack("<I", len(entries)) + entries.tobytes() + struct.pack("<I", len(edges)) + edges.tobytes()


def decode_index(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", raw)[0]
    entries = np.frombuffer(raw, ENTRY, n, 4)
    at = 4 + n * ENTRY.itemsize
    edges = np.frombuffer(raw, EDGE, struct.unpack_from("<I", raw, at)[0], at + 4)
    for code in np.unique(entries["precision"]):
        if int(code) not in NAME:
            raise ValueError(f"unknown precision {code}")
    return entries, edges


def write_file(path: str, layout: DataFrame, payloads: DataFrame, edges: DataFrame | None = None, model: str = "", mark: bytes = MARK) -> dict:
    """Write a layout file, one payload in memory at a time; edges (layer, a, b, weight) go in by (layer, a, b). Returns
    the experts, bytes and precisions written."""
    rows = layout.orderBy("pos").collect()  # as many as the model has experts
    entries = np.zeros(len(rows), ENTRY)
    for i, r in enumerate(rows):
        entries[i] = (r["layer"], r["expert"], r["offset"], r["len"], CODE[r["precision"]], b"", r["crc32"])
    links = np.array([(r["layer"], r["a"], r["b"], r["weight"]) for r in edges.orderBy("layer", "a", "b").collect()], EDGE) if edges is not None else np.zeros(0, EDGE)
    name, index = model.encode(), encode_index(entries, links)
    data_at = _up(HEADER + len(name))
    data_len = sum(_up(r["len"]) for r in rows)
    placed = payloads.select("layer", "expert", "payload").join(layout.select("layer", "expert", "offset"), ["layer", "expert"]).orderBy("offset")
    with Path(path).open("wb") as f:
        for r in placed.toLocalIterator():
            f.seek(data_at + r["offset"])
            f.write(r["payload"])
        f.truncate(max(data_at + data_len, HEADER + len(name)))
        f.seek(data_at + data_len)
        f.write(index)
        f.seek(0)
        f.write(encode_header(len({r["layer"] for r in rows}), len(rows), data_at + data_len, index, data_at, data_len, len(name), len(links), mark) + name)
    return {"experts": len(rows), "bytes_written": data_at + data_len + len(index), "precisions": sorted({r["precision"] for r in rows})}


def open_file(spark: SparkSession, path: str, mark: bytes = MARK) -> tuple[DataFrame, DataFrame, dict]:
    """Layout, edges and header (with model) of a layout file; fails on a region that is cut or does not match its checksum."""
    with Path(path).open("rb") as f:
        head = decode_header(f.read(HEADER), mark)
        size = f.seek(0, 2)
        if max(head["index_at"] + head["index_len"], head["data_at"] + head["data_len"], HEADER + head["name_len"]) > size:
            raise ValueError("the file is cut short")
        f.seek(HEADER)
        head["model"] = f.read(head["name_len"]).decode()
        f.seek(head["index_at"])
        raw = f.read(head["index_len"])
    if zlib.crc32(raw) != head["index_crc"]:
        raise ValueError("corrupt index")
    entries, edges = decode_index(raw)
    rows = [(int(e["layer"]), int(e["expert"]), i, int(e["offset"]), int(e["len"]), NAME[int(e["precision"])], int(e["crc32"])) for i, e in enumerate(entries)]
    layout = spark.createDataFrame(rows, "layer int, expert int, pos long, offset long, len long, precision string, crc32 long")
    links = spark.createDataFrame([(int(e["layer"]), int(e["a"]), int(e["b"]), float(e["weight"])) for e in edges], "layer int, a int, b int, weight double")
    return layout, links, head


def read_ranges(path: str, ranges: DataFrame, base: int) -> DataFrame:
    """ranges (offset, len, ...) with payload: the bytes of a file from base + offset on, read where the rows are; path is
    to be seen by all executors. Fails on a range beyond the file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Path(path).open("rb") as f:
            for b in batches:
                out = []
                for at, n in zip(b["offset"], b["len"], strict=True):
                    f.seek(base + int(at))
                    raw = f.read(int(n))
                    if len(raw) != n:
                        raise ValueError(f"{n} bytes from {base + int(at)} on are beyond the file")
                    out.append(raw)
                b["payload"] = out
                yield b

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranges.schema.fields)
    return ranges.mapInPandas(read, f"{kinds}, payload binary")


def read_experts(path: str, layout: DataFrame, head: dict) -> DataFrame:
    """layer, expert, payload; fails on a payload that does not match its checksum."""
    at = read_ranges(path, layout.select("layer", "expert", "offset", "len", "crc32"), head["data_at"])
    bad = F.raise_error(F.concat_ws(" ", F.lit("corrupt payload: layer"), F.col("layer").cast("string"), F.lit("expert"), F.col("expert").cast("string"))).cast("binary")
    return at.select("layer", "expert", F.when(F.crc32("payload") == F.col("crc32"), F.col("payload")).otherwise(bad).alias("payload"))


def execute(path: str, requests: DataFrame, head: dict) -> DataFrame:
    """requests (file_offset, span, ...) with the bytes that each transfer brings."""
    return read_ranges(path, requests.withColumnsRenamed({"file_offset": "offset", "span": "len"}), head["data_at"])


def gather(parts: DataFrame, tensors: DataFrame, path: str, data_at: int) -> DataFrame:
    """layer, expert, precision, payload: each expert's slices of the stacked tensors, by projection, from a tensor file.
    parts as expert_parts gives them; tensors (name, dtype, begin)."""
    at = parts.join(tensors.select("name", F.col("dtype").alias("precision"), "begin"), "name").select("layer", "expert", "projection", "precision", (F.col("begin") + F.col("offset")).alias("offset"), "len")
    at = read_ranges(path, at, data_at).groupBy("layer", "expert").agg(F.min("precision").alias("precision"), F.array_sort(F.collect_list(F.struct("projection", "payload"))).alias("p"))
    return at.select("layer", "expert", "precision", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["payload"])), "")).alias("payload"))


def verify(expected: DataFrame, found: DataFrame) -> DataFrame:
    """layer, expert, fault, first_difference (a byte's place, or null) for every expert (layer, expert, payload) that the two
    sides don't have alike; no rows: all bytes are the same."""
    both = expected.select("layer", "expert", F.col("payload").alias("x")).join(found.select("layer", "expert", F.col("payload").alias("y")), ["layer", "expert"], "full")
    fault = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "unexpected").when(F.length("x") != F.length("y"), "length").otherwise("bytes")
    differ = F.expr("filter(sequence(1, greatest(1, least(length(x), length(y)))), i -> substring(x, i, 1) <> substring(y, i, 1))[0] - 1")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select("layer", "expert", fault.alias("fault"), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), differ).alias("first_difference"))


def bench_file(spark: SparkSession, layers: int = 4, experts: int = 128, size: int = 2 << 20) -> DataFrame:
    """The layout of a file of equal experts, from index to index."""
    at = spark.range(layers * experts)
    return at.select((F.col("id") / experts).cast("int").alias("layer"), (F.col("id") % experts).cast("int").alias("expert"), F.col("id").alias("pos"), (F.col("id") * _up(size)).alias("offset"), F.lit(size).cast("long").alias("len"))
