"""The registered queries of this folder, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backhaul.llm import (decontaminate, dialogues, langid, licenses, merkle, minhash, mixing,
                          ordinal, secrets, sentencepiece, suffix, toxicity, vectors)
from backhaul.llm.batches import crc_fold

#: Model file of the registered queries; operators take any.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def _label(span):
    return F.concat_ws(":", span["kind"], span["start"].cast("string"),
                       span["end"].cast("string"))


def op1_secret_scan(spark: SparkSession, directory: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, directory, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
                        F.array_join(F.transform("found", _label), ",").alias("spans"))


def op2_sentencepiece(spark: SparkSession, directory: str) -> DataFrame:
    model = sentencepiece.read_model(TOKENIZER)
    documents = table(spark, directory, "documents").select("doc_id", "text")
    return sentencepiece.encode(documents, model, decoded="decoded").select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op3_quality(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    model = ordinal.train(documents, table(spark, directory, "labels"))
    return ordinal.score(documents, model).withColumn(
        "held_out", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)))


def op4_embedding_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, directory, "embeddings"))


def op5_license_scan(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    # the table has no paths: documents stand in folders of 20 within folders of 1,000
    path = F.concat(F.expr("cast(doc_id div 1000 as string)"), F.lit("/"),
                    F.expr("cast(doc_id div 20 as string)"), F.lit("/"),
                    F.col("doc_id").cast("string"), F.lit(".txt"))
    return licenses.scan(documents.select("doc_id", "text", path.alias("path")))


OP5_PATH = "(doc_id // 1000) || '/' || (doc_id // 20) || '/' || doc_id || '.txt'"


def op6_suffix_dedup(spark: SparkSession, directory: str) -> DataFrame:
    done = suffix.deduplicate(table(spark, directory, "documents"))
    return done.select(
        "doc_id", "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
        .alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op7_minhash_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, directory, "documents"))


def op8_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    model = toxicity.train(documents, table(spark, directory, "labels"))
    return toxicity.score(documents, model).select(
        "doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score", "predicted")


def op9_language(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    model = langid.train(documents)
    return langid.predict(documents, model).select(
        "doc_id", F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "lang_pred", "score")


def op10_decontaminate(spark: SparkSession, directory: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, directory, "documents"),
                                      table(spark, directory, "benchmark"))


def op11_source_mixing(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.mix(table(spark, directory, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op12_conversation_repair(spark: SparkSession, directory: str) -> DataFrame:
    conversations = table(spark, directory, "conversations")
    repaired = dialogues.repair(dialogues.damaged(conversations))

    def of(rows: DataFrame) -> Column:
        return everyone["conv_id"].eqNullSafe(rows["conv_id"])

    everyone = conversations.select("conv_id").distinct()
    digests = dialogues.digests(repaired.turns)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (everyone.join(repaired.audits, of(repaired.audits), "left")
            .join(digests, of(digests), "left")
            .select(everyone["conv_id"], *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


def op13_merkle_manifest(spark: SparkSession, directory: str) -> DataFrame:
    return merkle.manifest(table(spark, directory, "documents"), merkle.tampered())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_quality": op3_quality,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_license_scan": op5_license_scan,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_minhash_dedup": op7_minhash_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_language": op9_language,
        "op10_decontaminate": op10_decontaminate,
        "op11_source_mixing": op11_source_mixing,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": licenses.duckdb_sql("documents", OP5_PATH),
            "op12_conversation_repair": dialogues.duckdb_sql("conversations",
                                                             merkle.crc32_sql("code")),
            "op13_merkle_manifest": merkle.duckdb_sql("documents")}
