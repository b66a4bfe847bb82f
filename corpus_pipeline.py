"""Training-data pipeline: toxicity filter, near-duplicate removal, substring dedup, mixing and BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it again as the next stage's docs.
All but the last return the columns of ``documents``. Nulls, empty texts, repeated rows and empty tables pass as each stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.llm import bpe, jaccard, mixing, substring, toxicity
from legajo.llm.common import drop_scratch, free_names, id_crc, written
from legajo.llm.words import WORD_SQL
from legajo.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word CNN doesn't reject; it learns from the labels as operator 9 does."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), id_crc() % 5 != 0)
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked rows: the one with the least id (null last), then the least digest of id and text.

    Rows are told apart by id and text, so rows that share an id are judged one by one; of rows equal in both, one stays.
    Rows without words link with nothing and all stay.
    """
    wordy = F.coalesce(F.col("text").rlike(WORD_SQL), F.lit(False))
    (row,) = free_names(docs, "row")
    keyed = docs.where(wordy).withColumn(row, F.unhex(F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text")).cast("binary"))))
    found = jaccard.join_components(keyed, row=row)
    first = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first"))
    stays = first.select(F.col("first.row").alias(row))
    left = keyed.join(stays.hint("shuffle_hash"), row, "left_semi").dropDuplicates([row]).select(docs.columns)
    return left.unionByName(docs.where(~wordy))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 and more words that a document with a smaller id has."""
    return with_length(substring.without_repeats(docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts made of the words that the mix takes of each document, up to twice; documents that it takes nothing of go."""
    return with_length(mixing.mixed_texts(docs), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) and digests of every text."""
    return bpe.encode(docs, ids="binary")


def with_length(changed: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned weights, permutations and BPE have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; tables between stages lie in the shared folder and go as soon as the next one is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            drop_scratch(before)
    return STAGES[-1][1](spark, docs, sf_dir)
