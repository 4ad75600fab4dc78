"""A corpus-cleaning pipeline: each stage calls one operator and hands the documents that it keeps on.

All stages but the last return the columns of `documents`. Rows with a null id or text, repeated rows and empty tables
are handled as the operators say; columns beyond those of `documents` are handed on as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm import exact_dedup, language_id, near_dedup, packing, suffix_dedup
from isohyet.llm.common import free_name, scratch

LEAST_SHARE = 1 / 3  # of a document that its language must make up


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: rejected are those without a letter, and those of which no learned language makes up
    a third. Where no row has a label nothing can be learned, and all documents with a letter stay."""
    model = language_id.fit(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = (free_name(c, docs.columns) for c in ("lang_pred", "score"))
    seen = language_id.with_language(docs, model, lang_out=lang, score_out=score)
    return seen.filter((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SHARE)).select(*(F.col(f"`{c}`") for c in docs.columns))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id."""
    return exact_dedup.kept_rows(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, linked at a similarity of 0.8 or more: that with the smallest id."""
    return near_dedup.kept_rows(docs, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages, of more than 50 words or of 400 bytes; a document of which nothing is left
    goes. What a cut leaves of a character is dropped, and n_chars is counted anew where a text has changed."""
    found = suffix_dedup.remove_repeats(docs, carry=docs.columns, words=51)
    changed = F.col("text") != F.coalesce(F.col("rest.text"), F.lit(""))
    text = F.when(changed, F.col("text")).otherwise(F.col("rest.text"))
    columns = {"text": text, "n_chars": F.when(changed, F.char_length(text).cast("long")).otherwise(F.col("rest.n_chars"))}
    left = found.filter(~changed | (F.col("text") != ""))
    return left.select(*(columns.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed documents."""
    return packing.pack(docs)


STAGES = [
    ("language_id", by_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("suffix_dedup", without_repeats),
    ("packing", packed),
]
#: Hashed sketches, suffix arrays and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again; a stage's own tables go once it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
