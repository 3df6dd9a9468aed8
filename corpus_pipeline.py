"""From raw documents to token files: quality rules, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all but the last return the
columns of documents, and further ones where docs has them. Between stages the rows are written as Parquet and read again, and the
table before is deleted. Every stage gives an empty result for an empty table; nulls, repeated rows and ties are told stage by stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import discard, row_ids, table, written
from tessella.llm.decontaminate import contaminated_pairs
from tessella.llm.minhash_dedup import near_rows
from tessella.llm.mixture import mixed_documents
from tessella.llm.quality_rules import good_documents
from tessella.llm.queries import tokenizer_path
from tessella.llm.token_output import token_output


def _by_id(docs: DataFrame, ids: Column, found: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose id in the column ids is (left_semi) or isn't (left_anti) in found; columns of any name stay."""
    return docs.select(F.struct("*").alias("row"), ids.alias("id")).join(found.select(F.col("did").alias("id")), "id", how).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified thresholds keep. A null or empty text fails the base rules; a null lang is a stratum; repeated rows
    are judged alike, and one with a repeated id counts in the holdout each time."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id (shingles of five words, similarity 0.8 or more). Rows
    without an id are told by text and stay where no row with an id is in their group. Texts without words are in no group. Rows of one id are one
    document and stay or go together, repeated rows as often as they are there."""
    ids, _ = row_ids(docs)
    return _by_id(docs, ids, near_rows(docs.select(ids.alias("did"), "text")).where("first = did"), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, whole or by half or more of its words in any order. Rows without an id are told by text; rows of one id go
    together. Null and empty texts and items hold nothing."""
    ids, _ = row_ids(docs)
    pairs = contaminated_pairs(docs.select(ids.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _by_id(docs, ids, pairs.select(F.col("doc_id").alias("did")).distinct(), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. A null source is a source, a null id draws by its text, a text without words comes once for each
    complete epoch, equal rows share what the mix takes of them; equal draws are ordered by id and text."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' digest: doc_id, start, n_tokens, ids_crc32. A null or empty text is the end id alone; null ids come last, equal ids in order of text."""
    return token_output(docs, tokenizer_path(), words_held=200_000)  # workers also hold what the stages before left


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mixing), ("token_output", tokens)]

#: Tokenising, MinHash confirmation and string tiling have no SQL form; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; the last stage's rows."""
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(*held)
        held = [docs]
    out = STAGES[-1][1](spark, docs, sf_dir)  # its files are written by now
    discard(*held)
    return out
