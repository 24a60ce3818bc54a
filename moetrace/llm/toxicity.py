"""Toxicity scores behind a noisy-channel deobfuscation.

A character trigram model is counted over the whole corpus. A token that looks disguised (digits or symbols among its
letters, letters set apart by single separators, a letter three times or more in a row) becomes a lattice of what each
character may stand for, and Viterbi decoding under the model and the channel's costs restores it. Restored words and
their beginnings are features; those that labelled rows show to go with the label far beyond chance form a lexicon, and
a logistic curve fitted on the same rows turns the weights found in a text into a score.

Defined results: null and empty texts score as texts without any feature; without labels of both kinds every score is
the share of toxic labels, or 0; repeated labels of a document count once a value; a column score is replaced. At most
2 * FIT_ROWS labelled documents are learned from, and a lexicon holds at most MOST_FEATURES features, the strongest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, small_batches

#: Labelled rows of either kind that the lexicon is fitted on at most: a sample by a hash of doc_id.
FIT_ROWS = 6000
#: Features kept at most, the strongest first.
MOST_FEATURES = 20_000
PREFIXES = (4, 5, 6)

# Letters the model tells apart, and what a disguise may stand for.
ALPHABET = "abcdefghijklmnopqrstuvwxyzäöüßéèêëáàâçñíìîïóòôúùûœæ"
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
SEPARATORS = " .-_*'~^,/\\"
#: Costs in natural logarithms: reading a symbol as a letter, dropping a separator, another symbol or a digit, dropping a repeated letter (in runs of three or more, else).
AS_LETTER, DROP, DROP_SYMBOL, DROP_DIGIT, DROP_REPEAT, DROP_DOUBLE = 0.5, 0.3, 2.0, 8.0, 0.1, 6.0

K = len(ALPHABET) + 2  # 0 is a word's edge, the last any other letter
CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}
SPACED = re.compile(r"(?<!\S)(?:[^\W_] ){2,}[^\W_](?!\S)")
DISGUISED = re.compile(r"[0-9@$!|+€.\-_*'~^,/\\]|(.)\1\1")


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """K x K x K counts over all texts: partial counts per batch, added up by trigram."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                fold[c] = CODE.get(low, K - 1)
        total = np.zeros(K**3, np.int64)
        for x in batches:
            for text in x["text"].dropna():
                for i in range(0, len(text), 1 << 18):
                    f = fold[np.frombuffer(f" {text[i : i + (1 << 18)]} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
                    g = (f[:-2] * K + f[1:-1]) * K + f[2:]
                    total += np.bincount(g, minlength=K**3)
        yield pd.DataFrame({"gram": (at := np.flatnonzero(total)), "n": total[at]})

    sums = docs.select("text").mapInPandas(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(K**3)
    out[sums["gram"].to_numpy(int)] = sums["n"].to_numpy()
    return out.reshape(K, K, K)


class Decoder:
    """Viterbi decoding of disguised tokens under a trigram model."""

    def __init__(self, counts: np.ndarray):
        two = counts.sum(axis=2, keepdims=True)
        one = counts.sum(axis=(0, 1)) + 1.0
        pair = counts.sum(axis=0)
        low = (pair + 5 * one / one.sum()) / (pair.sum(axis=1, keepdims=True) + 5)
        self.log = np.log((counts + 5 * low[None]) / (two + 5)).astype(np.float32)

    def restore(self, token: str) -> str:
        """The likeliest word behind a lower-case token."""
        # A state is the last two letters; what was read before them is kept as linked pairs.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i, c in enumerate(token):
            steps: list[tuple[str, float]] = []
            if c.isalpha():
                steps.append((c, 0.0))
                if i and token[i - 1] == c:
                    run = (i > 1 and token[i - 2] == c) or token[i + 1 : i + 2] == c
                    steps.append(("", DROP_REPEAT if run else DROP_DOUBLE))
            else:
                steps += [(x, AS_LETTER) for x in LEET.get(c, "")]
                steps.append(("", DROP if c in SEPARATORS else DROP_DIGIT if c.isdigit() else DROP_SYMBOL))
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (s, out) in states.items():
                for x, cost in steps:
                    k = CODE.get(x, K - 1) if x else 0
                    to = (b, k) if x else (a, b)
                    now = s - cost + (float(self.log[a, b, k]) if x else 0.0)
                    if to not in after or after[to][0] < now:
                        after[to] = (now, (out, x) if x else out)
            states = after
        held = max(((s + float(self.log[a, b, 0]), a, b) for (a, b), (s, _) in states.items()), default=None)
        out, letters = states[held[1:]][1] if held else None, []
        while out:
            out, x = out
            letters.append(x)
        return "".join(reversed(letters))

    def word(self, token: str) -> str:
        """What a lower-case token says: its letters, restored if they look disguised."""
        end = len(token)
        while end and not token[end - 1].isalnum():
            end -= 1
        start = 0
        while start < end and not token[start].isalnum() and token[start] not in LEET:
            start += 1
        token = token[start:end]
        if DISGUISED.search(token) and any(c.isalpha() for c in token):
            return self.restore(token)
        return token


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens; letters set apart by single spaces are joined in one."""
    low = text.lower()
    found = set(low.split())
    found.update(m.group().replace(" ", ".") for m in SPACED.finditer(low))
    return found


def features(word: str) -> list[str]:
    return [f"={word}", *(f"{word[:n]}-" for n in PREFIXES if len(word) >= n)] if len(word) > 2 else []


class _Memo(dict):
    """Results of a function of a token; emptied when it has grown large."""

    def __init__(self, of):  # noqa: ANN001
        self.of = of

    def __missing__(self, token: str):  # noqa: ANN204
        if len(self) > 300_000:
            self.clear()
        self[token] = out = self.of(token)
        return out


class Scorer:
    def __init__(self, decoder: Decoder, weights: dict[str, float], slope: float = 1.0, base: float = 0.0):
        self.decoder, self.weights, self.slope, self.base = decoder, weights, slope, base

    def memo(self) -> _Memo:
        return _Memo(lambda t: max(((self.weights[f], f) for f in features(self.decoder.word(t)) if f in self.weights), default=None))

    def strength(self, text: str | None, memo: _Memo) -> float:
        """The sum of the weights of the distinct features found, a token's strongest one each."""
        found = {memo[t] for t in tokens(text or "")}
        return float(min(30.0, sum(x[0] for x in found if x)))

    def score(self, text: str | None, memo: _Memo) -> float:
        z = self.base + self.slope * self.strength(text, memo)
        return float(1 / (1 + np.exp(-z)))


def fit(docs: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Scorer:
    """A scorer of docs (doc_id, text) from labelled (doc_id, toxic); the model counts all docs."""
    spark = docs.sparkSession
    small_batches(spark)
    decoder = Decoder(count_trigrams(docs))
    labelled = labelled.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("_y")).distinct()
    n = {r["_y"]: r["count"] for r in labelled.groupBy("_y").count().collect()}
    if len(n) < 2:
        return Scorer(decoder, {}, 0.0, 20.0 if 1 in n else -20.0)
    share = F.when(F.col("_y") == 1, F.lit(fit_rows / n[1])).otherwise(F.lit(fit_rows / n[0]))
    part = labelled.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    rows = docs.select("doc_id", "text").join(F.broadcast(part), "doc_id").select("text", "_y")  # part: about 2 * fit_rows rows
    held = Shared(spark, Scorer(decoder, {}))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Memo(lambda t: tuple(features(held.value.decoder.word(t))))
        for x in batches:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(x["text"], x["_y"], strict=True):
                found[y].update({f for t in tokens(text or "") for f in memo[t]})
                found[y][""] += 1
            names = list(found[0] | found[1])
            yield pd.DataFrame({"feature": names, "n0": [found[0][f] for f in names], "n1": [found[1][f] for f in names]})

    sums = rows.mapInPandas(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sums = sums.where("feature = '' or n1 >= 4").persist()
    m = sums.where("feature = ''").first()
    if m is None or not m["n0"] or not m["n1"]:
        sums.unpersist()
        return Scorer(decoder, {}, 0.0, -20.0)
    m0, m1 = m["n0"], m["n1"]
    weight = F.log((F.col("n1") + 0.5) / (m1 + 1)) - F.log((F.col("n0") + 0.5) / (m0 + 1))
    both, e1 = F.col("n0") + F.col("n1"), (F.col("n0") + F.col("n1")) * m1 / (m0 + m1)
    gain = F.col("n1") * F.log(F.col("n1") / e1) + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / (both - e1))).otherwise(0)
    # Far beyond chance for the number of features looked at: half of G squared above its logarithm, and more.
    strong = sums.where("feature <> ''").select("feature", weight.alias("w"), gain.alias("g")).where(F.col("w") > 1.5)
    strong = strong.where(F.col("g") > float(np.log(max(100, sums.count())) + 1)).orderBy(F.desc("g"), "feature").limit(MOST_FEATURES)
    weights = {r["feature"]: float(r["w"]) for r in strong.collect()}
    sums.unpersist()
    known = Shared(spark, Scorer(decoder, weights))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = known.value.memo()
        for x in batches:
            yield pd.DataFrame({"y": x["_y"], "s": [known.value.strength(t, memo) for t in x["text"]]})

    seen = rows.mapInPandas(measure, "y int, s double").toPandas()  # the same bounded sample
    # Logistic curve by Newton's method; rows weigh as the labels do outside the sample.
    y, s = seen["y"].to_numpy(float), seen["s"].to_numpy() / 4
    w = np.where(y == 1, n[1] / m1, n[0] / m0)
    w = w / w.sum() * len(w)
    beta, x = np.zeros(2), np.c_[np.ones(len(s)), s]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (w * (y - p)) - 0.1 * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return Scorer(decoder, weights, float(max(0.0, beta[1]) / 4), float(beta[0]))


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs with score."""
    small_batches(docs.sparkSession)
    held = Shared(docs.sparkSession, scorer)

    @F.pandas_udf("double")
    def say(text: pd.Series) -> pd.Series:
        if not hasattr(held, "memo"):
            held.memo = held.value.memo()
        return pd.Series([held.value.score(t, held.memo) for t in text], dtype=float)

    return docs.withColumn("score", say("text"))
