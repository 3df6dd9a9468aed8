"""The corpus operators as queries over the supplied tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import ship, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.chat_format import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).drop("kept_text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.suffix_dedup import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.mixture import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.decontaminate import contaminated_pairs

    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.token_output import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_chat_format, op2_line_dedup, op3_quality_rules, op4_suffix_dedup, op5_mixing, op6_decontamination, op7_minhash_dedup,
        op8_token_output, op9_html_extraction, op10_token_counts, pipeline,
    )

    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in ops}


def oracle_sql() -> dict[str, str]:
    from tessella.llm.oracles import ORACLES

    return dict(ORACLES)
