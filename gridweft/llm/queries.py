"""The registered queries of this subpackage: the contracts' columns over the whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, exact_dedup, langid, mixture, pii, quality, secrets, simhash, token_output


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = langid.predict(docs, langid.samples(docs))
    return out.select("doc_id", (langid.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = quality.predict(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", (langid.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def secret_columns(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["name"].isin(*secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["name"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.written_spans(base).cast("binary"), 256).alias("base_sha256"), secrets.written_spans(F.col("spans")).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_columns(secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def pii_columns(found: DataFrame) -> DataFrame:
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_columns(pii.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, shards = token_output.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return token_output.read(spark, where, shards)


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer=(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_exact_dedup, op3_bpe, op4_language, op5_quality, op6_embeddings, op7_secrets, op8_token_files, op9_pii, op10_mixture)}
ORACLES = {"op2_exact_dedup": exact_dedup.ORACLE, "op6_embeddings": embed_dedup.ORACLE}
