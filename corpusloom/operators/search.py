"""Ranked search over weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.index import query_terms

LIMIT = 20
COLUMNS = "doc_id long, doc_name string, score double, match_count long"


def parse(spark, query: str) -> tuple[list[str], bool]:
    """(tokens, whether the query is a phrase); the query runs through the documents' own chain."""
    phrase = T.is_phrase(query)
    text = query[1:-1] if phrase else query
    return list(spark.range(1).select(T.tokens(F.lit(text)).alias("t")).first()["t"]), phrase


def search(weights: DataFrame, names: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, doc_name, score, match_count)``.

    Terms: any may match; score = sum of weights * (1 + matches / 2); the best ``limit``. A quoted query:
    all terms must be there (places are not compared); score = sum of weights, no boost and no limit.
    Repeated query terms count each time.
    """
    spark = weights.sparkSession
    terms, phrase = parse(spark, query) if query else ([], False)
    if not terms:
        return spark.createDataFrame([], COLUMNS)
    wanted = F.broadcast(query_terms(spark, terms))
    hit = weights.filter(F.col("term").isin(sorted(set(terms)))).join(wanted, "term")
    by_doc = hit.groupBy("doc_id").agg(F.sum(F.col("tfidf") * F.col("times")).alias("s"), F.sum("times").alias("match_count"), F.count("*").alias("found"))
    if phrase:
        ranked = by_doc.filter(F.col("found") == len(set(terms))).select("doc_id", F.round("s", 6).alias("score"), "match_count").orderBy(F.desc("score"), "doc_id")
    else:
        ranked = by_doc.select("doc_id", F.round(F.col("s") * (1 + 0.5 * F.col("match_count")), 6).alias("score"), "match_count").orderBy(F.desc("score"), "doc_id").limit(limit)
    return ranked.join(names.select("doc_id", "doc_name"), "doc_id", "left").select("doc_id", F.coalesce("doc_name", F.lit("Unknown")).alias("doc_name"), "score", "match_count")
