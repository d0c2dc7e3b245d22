"""A training corpus from documents: language ID, line dedup, near-duplicate
removal, pseudonyms, packing.  Each stage takes (spark, docs, sf_dir); all but the
last return the columns of documents, with n_chars made anew where text changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import materialize
from sievework.llm.langid import UNKNOWN, learn, predict, train_rows
from sievework.llm.line_dedup import dedup_lines
from sievework.llm.ngram_join import representatives
from sievework.llm.packing import pack
from sievework.llm.pii import pseudonymize
from sievework.llm.queries import pseudonym_key, tokenizer_path

#: A document is rejected below this cosine with every language, or without letters.
LEAST_SCORE = 0.05


def _with_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of `_row`, with another text."""
    made = {"text": F.col(text), "n_chars": F.char_length(text).cast("long")}
    return df.select(*[made[c].alias(c) if c in made else F.col(f"_row.`{c}`").alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without letters, or like none, go.

    Null and empty texts have no letters.  With no labelled row there is no language to
    be unlike, so only documents without letters go.  Whole texts are judged, repeated
    rows alike; an empty table stays empty.
    """
    model = learn(train_rows(docs))
    if not model[0]:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    judged = predict(docs.select(F.struct("*").alias("_row")), *model, ["_row"])
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; every document stays, if only with an empty
    text, as one of null text does.  Rows of one doc_id are one document, null last."""
    return _with_text(dedup_lines(docs), docs.columns, "_kept")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays: the smallest doc_id (null
    last), then the smallest hash of its text.  Equal rows stay once."""
    keep = representatives(docs).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
    own = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_i"), F.xxhash64(F.col("text").cast("string")).alias("_t"))
    return own.join(keep, F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_h")), "left_semi").dropDuplicates(["_i", "_t"]).select("_row.*")


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated personal data give way to pseudonyms of their format; null texts stay null,
    repeated rows are masked alike."""
    return _with_text(pseudonymize(docs, pseudonym_key(spark)), docs.columns, "_masked")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, none across documents."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("pseudonyms", pseudonyms), ("packing", packing)]

#: Vocabularies, random vectors and keyed hashes are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
