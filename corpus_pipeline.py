"""A training-text pipeline of five stages, each taking (spark, docs, sf_dir) and returning a DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import bpe, decontaminate, minhash, secrets, toxicity
from logweave.llm._store import forget, keep


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go.

    Null and empty texts get the score of no n-gram, rows of any doc_id (null too) are each scored by their text, repeated rows alike.
    The classifier learns from the documents that labels.parquet names; where it has not both labels, every text gets the rate of label 1.
    An empty table stays empty, columns of any name are kept.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "toxicity_score"
    while name in docs.columns:
        name += "_"
    return toxicity.flag(docs, model, name).where(F.col(name) < 0.5).select(docs.columns)


def one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies stays (shingles of five words, similarity 0.8 or more).

    Null texts and texts without words are copies of nothing, rows without doc_id stay, rows that repeat a doc_id stay or go together.
    An empty table stays empty, columns of any name are kept.
    """
    return minhash.one_of_each(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null texts have no words and stay, repeated rows are each judged by their text; an empty benchmark removes nothing.
    An empty table stays empty, columns of any name are kept, also those that the search itself uses.
    """
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, documents stay.

    Null texts stay null, repeated rows are each masked alike. Where there are too few findings to learn from, the rules alone decide.
    An empty table stays empty, columns of any name are kept.
    """
    return secrets.redact(docs, secrets.train(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and whether they spell its text again.

    A null text counts as empty: no ids, which spell it again. Repeated rows are each encoded. An empty table stays empty; the result has
    doc_id, lang, source, n_tokens, ids and round_trip, and no other column of docs.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", one_near_copy),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("bpe", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder, read by the next and deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = keep(stage(spark, docs, sf_dir), name)
        forget(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
