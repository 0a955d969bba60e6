"""Corpus cleaning: stages run one after the other over ``documents``.

Each stage reads all that its predecessor kept, from Parquet; all but the last return the columns
of ``documents``. Toxic documents go; of near-duplicates the smallest doc_id stays; passages that a
document with a smaller doc_id has are cut out; documents that hold a benchmark item go; what is
left is encoded, and checked by decoding.

Clean documents stay: a null or empty text has no evidence against it and passes every stage, and
a document that loses a passage keeps the rest of its text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import bpe, decontam, minhash, suffix_dedup, toxicity
from loomgrid.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Up to so many ids are sent to the tasks, 8 MB; beyond, documents and ids meet by shuffle.
SENT_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id isn't in ``ids``; those with a null doc_id stay."""
    ids = materialize(ids.select("doc_id").distinct(), "dropped")
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    return docs.select(*COLUMNS).join(ids, "doc_id", "left_anti").select(*COLUMNS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < 0.3).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(docs.select("doc_id", "text"), width=5, threshold=0.8)
    return without(docs, found.where(~F.col("kept")))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(docs.select(*COLUMNS), whole_characters=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))
    cut = found.withColumn("text", text)
    return cut.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, found)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = bpe.encode(docs.select(*COLUMNS), "text", ranks, public_tokenizers.PATTERN, verify="round_trip")
    return ids.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

#: Learning, hashing and suffix arrays have no SQL here; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
