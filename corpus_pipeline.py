"""A corpus from documents to packed training sequences. Each stage works on all that the one before kept.

Every stage but the last returns the columns of its input, whatever these are besides doc_id, text, source and
n_chars; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws: as large a share of all as labelled documents have quality 1. Null and empty texts are never drawn."""
    from quiverql.llm import resampling
    from quiverql.llm.base import table

    return resampling.kept(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts fail them, repeated rows are judged alike."""
    from quiverql.llm import rules
    from quiverql.llm.base import table

    return rules.kept(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies; one of rows equal in id and text, all rows with a null text."""
    from quiverql.llm import order_minhash

    return order_minhash.firsts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and with the words, that the mix takes; n_chars follows the text. Texts without words aren't taken."""
    from quiverql.llm import mixing

    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 2048 tokens; a null or empty text is one piece of one id."""
    from quiverql.llm import packing
    from quiverql.llm.queries import tokenizer_file

    return packing.pack(docs, tokenizer_file(), cap=2048, end_id=0)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express these stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again, and its own tables go then."""
    from quiverql.llm.base import Workspace, scratch, table

    space, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES[:-1], 1):
        with scratch():
            docs = space.save(stage(spark, docs, sf_dir), f"stage-{at}")
    return STAGES[-1][1](spark, docs, sf_dir)
