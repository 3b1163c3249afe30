"""From raw documents to tokens: toxic, copied and contaminated documents go, secrets are masked.

Every stage takes the documents its predecessor kept, as Parquet, and all but the last return the
columns of ``documents``. A document without a text passes every stage; its token ids are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backhaul.llm import decontaminate, minhash, secrets, sentencepiece, toxicity
from backhaul.llm.queries import TOKENIZER, table
from backhaul.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and ``n_chars`` that of the masked text."""
    masked = secrets.mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text, with whether they decode to that text.

    ``token_ids``, ``n_tokens`` and ``round_trip`` replace columns of those names.
    """
    model = sentencepiece.read_model(TOKENIZER)
    names = [c for c in docs.columns if c not in ("text", "token_ids", "n_tokens", "round_trip")]
    decoded = sentencepiece.encode(docs, model, decoded="_decoded")
    return decoded.select(
        *names, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"),
        F.col("_decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("sentencepiece", tokenize),
]
#: No stage can be said in SQL as a whole; the tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
