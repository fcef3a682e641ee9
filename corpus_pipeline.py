"""The corpus pipeline: language ID, exact and near deduplication, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but
the last return the columns of documents, extra ones included, whatever they are called. Texts are
read whole at any length; an empty table stays an empty table; repeated rows count as rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.llm import bpe, common, exact_dedup, langid, mixture, simhash

#: Rank file and pattern of the last stage; mixing counts its tokens.
TOKENIZER = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
#: Mean phrase length under which a text is in no learned language: hardly more than letter by letter. Texts of the learned languages have 3 and more.
LEAST_PHRASE = 2.0
#: Bits in which the fingerprints of near-duplicates may differ.
LINK = 4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts, texts without letters (empty ones too), and texts that no learned language parses into phrases of LEAST_PHRASE characters.

    Where nothing was learned (no labelled rows) no text has a language and all go. A null lang
    becomes the predicted language, so that mixing rakes it with its own; given ones stay.
    """
    found = langid.predict(docs, langid.samples(docs), keep_columns=True).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("phrase_chars") >= LEAST_PHRASE))
    own = [F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns]
    return found.select(*own)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text that is the same but for white space: most code points, then smallest id (null ids last, of rows alike in both one). Null and empty texts are one text."""
    return exact_dedup.dedup(docs, keep_columns=True).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id (null ids last), of each group linked by SimHash or by similarity.

    SimHash links fingerprints of the distinct five-word shingles that differ in at most LINK bits,
    by covering masks; a similarity of 0.8 of these shingles links as well, since few such texts are
    that near by fingerprint. All links of both kinds are found. Null texts and texts without words are alike.
    """
    return simhash.similar_groups(docs, link=LINK).where("kept").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents towards flatter source, language and topic shares of tokens. Null categories are categories; repeated rows are drawn alike."""
    return mixture.mix(docs, keep_columns=True, tokenizer=TOKENIZER).where("sampled").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests of ids and decoded text: (doc_id, n_tokens, ids_sha256, decoded_sha256, ids), a row for each row. Null and empty texts have no tokens."""
    return bpe.encode(docs, *TOKENIZER, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("mixture", mix_sources),
    ("byte_bpe", encode),
]
#: The stages are learned, iterative or tokenise: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, common.written(stage(spark, docs, sf_dir), name)
        if k:
            common.remove(before)
    return STAGES[-1][1](spark, docs, sf_dir)
