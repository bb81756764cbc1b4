"""From raw documents to tokens: the stages of the pipeline, each an operator of ``cartolex.llm``.

Every stage but the last takes documents and gives documents: the same columns, some rows less or some texts changed.
"""

from __future__ import annotations

import public_tokenizers as public
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolex.llm.bpe import WORDS, decode, encode
from cartolex.llm.common import stored, table
from cartolex.llm.decontaminate import cut_leaks
from cartolex.llm.near_dedup import near_duplicates
from cartolex.llm.personal_data import mask_personal_data
from cartolex.llm.quality import grades_of, score, train
from cartolex.llm.queries import GOOD, LEAST_CHANCE

RANKS = public.path("byte_bpe_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good with a chance of at least LEAST_CHANCE, by a model of the labelled ones among them."""
    model = train(docs, grades_of(table(spark, sf_dir, "labels")))
    return score(docs, model, GOOD).filter(F.col("chance") >= LEAST_CHANCE).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id. Rows without an id stay.

    Rows that share an id are one document: repeated rows of a kept id are not reduced, and all reach the next stage.
    """
    gone = near_duplicates(docs, words=5, percent=80).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; one that is nothing else goes."""
    return cut_leaks(docs, table(spark, sf_dir, "benchmark"), window=10)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the name of its kind in place of each span of personal data."""
    return mask_personal_data(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    out = decode(encode(docs.select("doc_id", "lang", "source", "text"), RANKS, public.PATTERN, WORDS), RANKS)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"), "ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("personal_data", personal_data), ("tokens", tokens)]

#: The stages fit models and follow links; plain SQL cannot say that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
