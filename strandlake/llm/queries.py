"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, neardup, pagetext, pieces, quality, quotes, secrets, substrings, toxicity
from .store import table

PIECE_MODEL = "piece_bpe_32k.model"


def piece_model() -> str:
    """The path of the public sentencepiece model (a parameter of the operator)."""
    import public_tokenizers

    return str(public_tokenizers.path(PIECE_MODEL))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_order(table(spark, sf_dir, "conversations"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_query(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest_query(table(spark, sf_dir, "documents"))


def op7_pagetext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.main_text(table(spark, sf_dir, "pages"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), piece_model())


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_quotes, op3_decontaminate, op4_quality, op5_langid, op6_substrings, op7_pagetext, op8_pieces, op9_neardup, op10_secrets)}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express; the others are tested against plain loops, exact round trips or
    held-out rows."""
    return {"op2_quotes": quotes.SQL, "op3_decontaminate": decontaminate.SQL, "op6_substrings": substrings.SQL, "op9_neardup": neardup.SQL, "op10_secrets": secrets.SQL}
