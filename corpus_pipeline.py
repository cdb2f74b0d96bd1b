"""From raw documents to the token digests of a mixed corpus, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import bpe, langid, mixing, simhash, substring_dedup
from ravelin.llm.shared import cut, held_out


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language go; a null ``lang`` takes the predicted one.

    Where no row teaches a language, none is predicted: documents with a letter
    stay, with ``lang`` as it is.
    """
    out = held_out(F.col("doc_id"))
    model = langid.fit(docs, ~out & F.col("doc_id").isNotNull())
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, model, F.struct("*")).where("lang_pred != 'und'")
    return found.select([F.coalesce("keep.lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"keep.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also stand earlier are cut out; a document left without a word goes."""
    found = substring_dedup.dedup(docs, as_is=True).where("n_removed = 0 OR kept_text != ''")
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select([new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document in the mix, as digests."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL expresses neither the language model nor the merges; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
