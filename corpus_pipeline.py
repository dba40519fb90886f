"""A training corpus from ``documents``: toxicity filter, exact dedup, near dedup, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from leafmill.llm._spark import Scratch

SCORE = "_toxicity_score"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, by models of this input's labelled documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, Scratch(spark))
    return toxicity.score(docs, model, name=SCORE).filter(f"{SCORE} < {toxicity.THRESHOLD}").drop(SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal without white space, the longest."""
    return exact_dedup.dedup(docs, Scratch(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram similarity, the one with the smallest id."""
    return ngram_join.dedup(docs, Scratch(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    return mixing.mix(docs, Scratch(spark))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with the digests of ids and decoded text."""
    keep = tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns)
    return bpe.encode(docs, bpe.tokenizer_content(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep=keep)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("tokens", encode_texts),
]

#: The toxicity models have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
