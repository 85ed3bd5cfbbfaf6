"""TF-IDF: augmented term frequency times log10(N / df)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tf(count: Column, most: Column) -> Column:
    return F.when(most > 0, 0.5 + 0.5 * count / most).otherwise(F.lit(0.0))


def idf(n: Column, df: Column) -> Column:
    return F.when(df > 0, F.log10(n / df)).otherwise(F.lit(0.0))


def weights(post: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, term, tf, tfidf, df)``. N counts documents without tokens too. Terms in every document stay, at 0.

    Document frequencies are pre-aggregated and joined (a hot term's join partition can be split);
    the most frequent term of a document comes from a window on the postings' own partitioning.
    """
    n = docs.agg(F.count("*").alias("n")).scalar()
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    most = post.withColumn("most", F.max("tf").over(Window.partitionBy("doc_id")))
    return most.join(df, "term").select("doc_id", "term", "tf", (tf(F.col("tf"), F.col("most")) * idf(n, F.col("df"))).alias("tfidf"), "df")


def keywords(w: DataFrame, n: int = 10) -> DataFrame:
    """``(doc_id, rank, term, score)``: the n best terms by score to 6 digits, ties by term."""
    scored = w.select("doc_id", "term", F.round("tfidf", 6).alias("score"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).select("doc_id", "rank", "term", "score")


def dense_vectors(w: DataFrame, terms: list[str]) -> DataFrame:
    """``(doc_id, vector)``: each document's weights of the given terms in order, 0 where it has none.

    The caller names the terms, so a vector is as long as the caller makes it; the sparse weights are the
    form for whole vocabularies.
    """
    wanted = w.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("term").isin(terms), F.struct("term", "tfidf")))).alias("m"))
    return wanted.select("doc_id", F.transform(F.array(*map(F.lit, terms)), lambda t: F.coalesce(F.try_element_at("m", t), F.lit(0.0))).alias("vector"))


def word_cloud(keys: DataFrame) -> DataFrame:
    """``(term, weight)``: sums of the scores within the documents' keywords."""
    return keys.groupBy("term").agg(F.round(F.sum("score"), 4).alias("weight"))
