"""The training-data pipeline: stages over ``documents``, each written as Parquet and reread.

Each function takes (spark, docs, sf_dir) and works on all that its predecessor kept. Its result is written before
the next one is called, which deletes the intermediate tables of the one before. All but the
last return the columns of documents. Repeats that start or end within a character take the whole
character with them, and ``n_chars`` follows the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import packing, quality, simhash, suffix, toxicity
from corpusloom.llm.common import scope, table
from corpusloom.sources.tables import shared_dir


#: Most documents of one sequence of the last stage.
STAGE_DOCUMENTS = 32


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def staged(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scope(spark, "pipeline"):
            return stage(spark, docs, sf_dir)

    return run_stage


@staged
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.nontoxic(docs, table(spark, sf_dir, "labels"))


@staged
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs)


@staged
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.leaders(docs)


@staged
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.cut(docs)


@staged
def fill_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs), documents=STAGE_DOCUMENTS)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", fill_sequences),
]

#: SQL expresses neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpusloom/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
