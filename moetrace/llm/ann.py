"""Nearest neighbours by an inverted file with product-quantised residuals and exact reranking.

Coarse centroids and the codebooks of the residuals' parts are fitted on a bounded sample; every vector is indexed in its
nearest cell with its codes. A query probes its nearest cells; in each, asymmetric distance tables rank the codes, and
the best are reranked by the exact cosine in double precision. Cells are cut into blocks of bounded size, so a cell that
holds a third of all vectors is searched by many tasks, each giving its own k best, of which the k best overall remain;
the queries of a cell are cut into blocks too, each of which meets every block of the cell's vectors.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; ties go to the smaller vec_id; a row never finds itself (its own vec_id); with k candidates or fewer, all come;
rows with a null vec_id take no part; repeated rows are repeated candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, settle, small_batches

#: Rows the centroids and codebooks are fitted on at most; rows of a block; candidates reranked exactly in a block.
FIT_ROWS, BLOCK_ROWS, RERANK = 20_000, 4096, 192
#: Queries that meet a block at once, about.
ASKED = 8192
#: A query probes as many cells as this share of sampled neighbours needs, and cells until they hold LEAST vectors.
NEEDED, LEAST = 0.98, 2000
PARTS, CODES = 16, 256
MOST_CELLS = 4096


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ c.T).argmin(axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


class Index:
    def __init__(self, sample: np.ndarray, total: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        distinct = np.unique(x, axis=0)
        cells = int(max(1, min(np.sqrt(total) / 2, len(distinct) // 16, MOST_CELLS)))
        self.coarse = _kmeans(distinct, cells, rng)
        rest = distinct - self.coarse[_nearest(distinct, self.coarse)]
        self.cuts = np.array_split(np.arange(x.shape[1]), min(PARTS, x.shape[1]))
        self.books = [_kmeans(rest[:, p], min(CODES, len(rest)), rng, 8) for p in self.cuts]

        # How far down a row's list of nearest cells its 5 nearest sampled rows lie: near where vectors cluster, far where not.
        own, cell = rng.choice(len(x), min(len(x), 256), replace=False), _nearest(x, self.coarse)
        near = np.argsort(x[own] @ x.T * -1, axis=1)[:, 1:6]
        order = np.argsort(self._far(x[own]), axis=1)
        ranks = [np.flatnonzero(o == c)[0] for o, n in zip(order, near, strict=True) for c in cell[n]]
        self.probed = int(np.quantile(ranks, NEEDED)) + 1 if ranks else 1

    def _far(self, x: np.ndarray) -> np.ndarray:
        return (self.coarse**2).sum(axis=1) / 2 - x @ self.coarse.T

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        cell = _nearest(x, self.coarse)
        rest = x - self.coarse[cell]
        return cell, np.stack([_nearest(rest[:, p], b) for p, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)

    def distances(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of a unit query to coded vectors of a cell, from a table for each part."""
        rest = query - self.coarse[cell]
        return sum(((b - rest[p]) ** 2).sum(axis=1)[codes[:, i]] for i, (p, b) in enumerate(zip(self.cuts, self.books, strict=True)))

    def probes(self, x: np.ndarray, held: np.ndarray) -> list[np.ndarray]:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        out = []
        for o in np.argsort(self._far(x), axis=1):
            out.append(o[: max(self.probed, int(np.searchsorted(np.cumsum(held[o]), LEAST)) + 1)])
        return out


def _usable(vectors: DataFrame, vector: str) -> DataFrame:
    v = F.transform(vector, lambda x: x.cast("double"))
    at = vectors.where("vec_id is not null").select("vec_id", v.alias("_v")).where("size(_v) > 0 and forall(_v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(_v, x -> x <> 0)")
    return at


def search(vectors: DataFrame, asked: Column, k: int = 5, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows where asked holds, among all rows of vectors (vec_id, vector)."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    at = _usable(vectors, vector)
    sizes = at.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wide, total = sizes[0]["d"], sizes[0]["count"]
    at = at.where(F.size("_v") == wide)
    part = at.where(F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1_000_000)) < F.lit(min(1.0, FIT_ROWS / total) * 1_000_000))
    sample = np.array([r["_v"] for r in part.select("_v").collect()] or [r["_v"] for r in at.limit(1).collect()], float)
    index = Shared(spark, Index(sample, total))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            cell, codes = index.value.encode(np.stack(x["_v"].to_numpy()).astype(float))
            yield pd.DataFrame({"cell": cell, "vec_id": x["vec_id"], "_v": x["_v"], "codes": [c.tobytes() for c in codes]})

    rows = settle(at.mapInPandas(encode, "cell int, vec_id long, _v array<double>, codes binary"))
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # at most MOST_CELLS rows
    cells = len(index.value.coarse)
    held = np.array([counts.get(i, 0) for i in range(cells)])
    parts = np.maximum(1, -(-held // BLOCK_ROWS))

    asked_parts = max(1, -(-at.where(asked).count() // ASKED))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            v = np.stack(x["_v"].to_numpy()).astype(float)
            out = [(q, vec, int(c), int(b)) for q, vec, own in zip(x["vec_id"], x["_v"], index.value.probes(v, held), strict=True) for c in own for b in range(parts[c])]
            yield pd.DataFrame([(*r, r[0] % asked_parts) for r in out], columns=["query_id", "_q", "cell", "block", "part"])

    many = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("cell") + 1)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), many).cast("int"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(asked_parts - 1))))
    asking = at.where(asked).select("vec_id", "_v").distinct().mapInPandas(probe, "query_id long, _q array<double>, cell int, block int, part int")

    def rank(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(queries):
            own = own.sort_values("vec_id", kind="stable")
            ids, cell = own["vec_id"].to_numpy(), int(own["cell"].iloc[0])
            v = np.stack(own["_v"].to_numpy()).astype(float)
            norms = np.sqrt((v * v).sum(axis=1))
            codes = np.frombuffer(b"".join(own["codes"]), np.uint8).reshape(len(own), -1)
            for q, vec in zip(queries["query_id"], queries["_q"], strict=True):
                vec = np.asarray(vec, float)
                norm = np.sqrt((vec * vec).sum())
                d = index.value.distances(vec / norm, cell, codes)
                best = np.argsort(d, kind="stable")[: RERANK + 1] if len(d) > RERANK else np.arange(len(d))
                best = best[ids[best] != q]
                exact = (v[best] * vec).sum(axis=1) / (norms[best] * norm)
                for i in np.lexsort((ids[best], -exact))[:k]:
                    out.append((q, ids[best][i], exact[i]))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = asking.groupBy("cell", "block", "part").cogroup(rows.groupBy("cell", "block", "part")).applyInPandas(rank, "query_id long, vec_id long, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
