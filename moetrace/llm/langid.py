"""Language identification by error-correcting output codes.

Every learned language has a codeword; each bit of it is predicted by a binary classifier over hashed character n-grams
(n = 1 to 4, words joined by one space), a naive Bayes ratio between the mean n-gram distributions of the languages on
either side of the bit. Decoding adds, over the bits, a logistic loss of the margin against the codeword's bit, weighted
by the least margin that the bit's classifier gives to a language's mean distribution, and takes the codeword of least
loss. A row whose two best codewords are nearly as near is flagged ambiguous.

Defined results: null texts and texts without a letter are `und` with score 0; with nothing to learn from, every row is
`und`; rows with a null language are never learned from; columns lang_pred, score and ambiguous are replaced; ties go to
the first language by name. Rows that repeat a text are drawn one by one where they have ids of their own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, small_batches, without

#: Size of the hashed n-gram space, and the n.
SPACE, GRAMS = 1 << 16, (1, 2, 3, 4)
#: Rows a language is fitted on at most: a sample by a hash of doc_id and text.
FIT_ROWS = 3000
#: Codewords closer than this share of the best loss are ambiguous.
AMBIGUOUS = 0.05
UND = "und"
CHUNK = 1 << 18


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased words, with one space before each and one at the end; empty without a letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    x = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    x = np.concatenate((np.array([32], np.uint32), x, np.array([32], np.uint32)))
    x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]
    return x if len(x) > 1 else x[:0]


def grams(x: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams of the letters, in pieces."""
    for i in range(0, len(x), CHUNK):
        part = x[i : i + CHUNK + max(GRAMS) - 1].astype(np.uint64)
        h = np.zeros(len(part), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint64(1000003) + part[n - 1 :]
            if n in GRAMS:
                g = h[: CHUNK if i + CHUNK < len(x) else len(h)]
                yield ((g + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1: all splits of up to 7 languages, else random splits, about ten a doubling of n."""
    if not n:
        return np.ones((0, 1))
    if n <= 7:
        splits = [[1 - 2 * (i >> j & 1) for j in range(n)] for i in range(1, max(2, 1 << max(0, n - 1)))]
        return np.array(splits, float).T.reshape(n, -1)
    rng, wanted = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    code = np.empty((n, 0))
    while code.shape[1] < wanted or len(np.unique(code, axis=0)) < n:
        code = np.c_[code, rng.permutation(np.where(np.arange(n) % 2, 1.0, -1.0))]
    return code


class Model:
    """langs, codewords, per-bit weights of the n-grams and of the bits."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        share = (counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True) if len(langs) else counts
        self.weights = np.zeros((SPACE, self.code.shape[1]), np.float32)
        bits = np.ones(self.code.shape[1])
        for b in range(self.code.shape[1]):
            plus, minus = self.code[:, b] > 0, self.code[:, b] < 0
            if plus.any() and minus.any():
                self.weights[:, b] = np.log(share[plus].mean(axis=0)) - np.log(share[minus].mean(axis=0))
                # The least mean margin by which a language falls on its side: how well this bit separates.
                bits[b] = max(1e-3, ((share @ self.weights[:, b]) * self.code[:, b]).min())
        self.bits = bits / bits.sum()
        self.scale = 1.0 / np.maximum(np.abs(share @ self.weights).mean(axis=0), 1e-9) if len(langs) else bits

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        x = letters(text or "")
        if not len(x) or not self.langs:
            return UND, 0.0, True
        total, n = np.zeros(self.code.shape[1]), 0
        for g in grams(x):
            total += self.weights.take(g, axis=0).sum(axis=0, dtype=np.float64)
            n += len(g)
        margin = total / n * self.scale
        loss = np.logaddexp(0, -4 * margin * self.code) @ self.bits
        order = np.argsort(loss, kind="stable")
        p = np.exp(-4 * (loss - loss[order[0]]))
        unsure = len(order) > 1 and loss[order[1]] - loss[order[0]] < AMBIGUOUS * loss[order[1]]
        return self.langs[order[0]], float(1 / p.sum()), bool(unsure)


def fit(docs: DataFrame, learn: Column, fit_rows: int = FIT_ROWS) -> Model:
    """A model of the rows of docs (text, lang) where learn holds: up to about fit_rows a language, whole texts."""
    small_batches(docs.sparkSession)
    own = [c for c in ("doc_id", "text") if c in docs.columns]
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", *own)
    shares = {x["lang"]: min(1.0, fit_rows / x["count"]) for x in rows.groupBy("lang").count().collect()}
    if not shares:
        return Model([], np.zeros((0, SPACE)))
    share = F.create_map(*[F.lit(v) for kv in shares.items() for v in kv])[F.col("lang")]
    part = rows.where(F.pmod(F.xxhash64(F.lit("fit"), *own), F.lit(1_000_000)) < share * 1_000_000).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for x in batches:
            for text, lang in zip(x["text"], x["lang"], strict=True):
                at = found.setdefault(lang, np.zeros(SPACE, np.int64))
                for g in grams(letters(text)):
                    at += np.bincount(g, minlength=SPACE)
        for lang, at in found.items():
            yield pd.DataFrame({"lang": lang, "gram": (i := np.flatnonzero(at)), "n": at[i]})

    sums = part.mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    counts = np.zeros((len(langs), SPACE))
    for i, lang in enumerate(langs):
        own = sums[sums["lang"] == lang]
        counts[i, own["gram"].to_numpy()] = own["n"].to_numpy()
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous."""
    small_batches(docs.sparkSession)
    held = Shared(docs.sparkSession, model)  # SPACE x bits floats, whatever the input

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def say(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in text], columns=["lang_pred", "score", "ambiguous"])

    docs = without(docs, "lang_pred", "score", "ambiguous")
    return docs.withColumn("_said", say("text")).select(*docs.columns, "_said.*")
