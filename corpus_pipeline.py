"""A corpus pipeline over documents: language, lines, near duplicates, benchmark leaks, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moetrace.llm import decontaminate, langid, lines, minhash, packing
from moetrace.llm.common import among, settle, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or as near to one language's codeword as to another's, go.
    Texts of any length are read whole; repeated rows are judged alike."""
    model = langid.fit(docs, ~F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)))
    return langid.predict(docs.select(COLUMNS), model).where((F.col("lang_pred") != langid.UND) & ~F.col("ambiguous")).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and near-equal lines go; so do documents of which nothing is left. A null text stays. Rows that share doc_id
    and text are one document to this stage: each keeps what that document keeps."""
    out = lines.dedup_lines(docs.select(COLUMNS)).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, on shingles of five words; of rows that are equal in doc_id and
    text, one. Rows are told apart by a hash of both, so a null or a repeated doc_id takes no row out of the comparison;
    null and wordless texts are near nothing."""
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_key"))
    found = settle(minhash.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), size=5, percent=80).select(F.col("doc_id").alias("_key"), "kept"))
    gone = found.where("not kept").select("_key")
    twice = settle(found.where("kept").groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key"))
    once = among(keyed, twice, "_key").dropDuplicates(["_key"])
    return keyed.join(gone.union(twice).distinct(), "_key", "left_anti").select(COLUMNS).unionByName(once.select(COLUMNS))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts stay."""
    return decontaminate.find_items(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).where("size(items) = 0").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequences; a null text counts as empty."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack),
]

#: Classifiers, signatures and alignments have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
