"""Counting and the inverted index: everything hangs on the long table ``postings(doc_id, term, tf)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, doc_name, text)`` of the rows with an id and a text; other columns are pruned at the scan."""
    name = F.concat(F.lit("doc_"), F.col(id_col).cast("string"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), name.alias("doc_name"), F.col(text_col).alias("text")).filter((F.col("doc_id") >= 0) & (F.col("text") != ""))
    cores = df.sparkSession.sparkContext.defaultParallelism
    # few splits are dealt by id, so that what groups by document later needs no other shuffle
    return rows.repartition(cores, "doc_id") if rows.rdd.getNumPartitions() < cores // 2 else rows


def tokenised(docs: DataFrame, **more) -> DataFrame:
    return docs.select("doc_id", T.tokens(F.col("text"), **more).alias("terms"))


def postings(docs: DataFrame, keep_numbers: bool = False, **more) -> DataFrame:
    """``(doc_id, term, tf)``; the partial aggregate combines a document's words before any shuffle.

    Words are filtered after the explode, inside generated code, and not by a function over arrays.
    """
    words = docs.select("doc_id", F.explode(T.parts(F.col("text"), keep_numbers)).alias("term"))
    return words.filter(T.counts(F.col("term"), **more)).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def positions(docs: DataFrame) -> DataFrame:
    """``(doc_id, term, positions)``: places from 0 after filtering."""
    at = tokenised(docs).select("doc_id", F.posexplode("terms").alias("pos", "term"))
    return at.groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def vocabulary(post: DataFrame) -> DataFrame:
    """``(term, cf, df)``."""
    return post.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def inverted(post: DataFrame) -> DataFrame:
    """``(term, doc_ids)``, ascending."""
    return post.groupBy("term").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))


def posting_lists(post: DataFrame) -> DataFrame:
    """``(term, postings array<struct<doc_id, tf>>)`` by doc_id."""
    return post.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))


def doc_totals(docs: DataFrame) -> DataFrame:
    """``(doc_id, doc_name, total, unique_terms, density)``, documents without tokens too; no shuffle."""
    terms = T.tokens(F.col("text"))
    counted = docs.select("doc_id", "doc_name", terms.alias("terms")).select("doc_id", "doc_name", F.size("terms").cast("long").alias("total"), F.size(F.array_distinct("terms")).cast("long").alias("unique_terms"))
    return counted.withColumn("density", T.density(F.col("unique_terms"), F.col("total")))


def corpus_totals(docs: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """One row: documents, words, unique words, average length, density; from the vocabulary, if it is at hand."""
    vocab = vocabulary(postings(docs)) if vocab is None else vocab
    words = vocab.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("total_words"), F.count("*").alias("unique_words"))
    n = docs.agg(F.count("*").alias("n")).scalar()
    return words.select(n.alias("total_documents"), "total_words", "unique_words", F.round(F.when(n > 0, F.col("total_words") / n).otherwise(0.0), 6).alias("avg_length"), F.round(T.density(F.col("unique_words"), F.col("total_words")), 6).alias("density"))


def top_words(vocab: DataFrame, n: int = 50) -> DataFrame:
    """The n most frequent terms of a vocabulary with their share of all tokens, ties by term."""
    vocab = vocab.select("term", "cf")
    total = vocab.agg(F.sum("cf").alias("t")).scalar()
    return vocab.orderBy(F.desc("cf"), "term").limit(n).select("term", "cf", F.round(F.col("cf") * 100.0 / total, 4).alias("percentage"))


def top_counts(vocab: DataFrame, n: int = 200) -> DataFrame:
    """The n most frequent terms, in alphabetical order."""
    return top_words(vocab, n).select("term", "cf").orderBy("term")


def top_terms_per_doc(post: DataFrame, n: int = 50) -> DataFrame:
    best = Window.partitionBy("doc_id").orderBy(F.desc("tf"), "term")
    return post.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).select("doc_id", "term", "tf")


def lookup(post: DataFrame, term: str) -> DataFrame:
    """A term's postings by tf, then doc_id; the filter reaches the scan of a stored index."""
    return post.filter(F.col("term") == term).select("doc_id", "tf").orderBy(F.desc("tf"), "doc_id")


def search_and(post: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with all terms (none for no terms)."""
    wanted = sorted(set(terms))
    found = post.filter(F.col("term").isin(wanted) if wanted else F.lit(False))
    return found.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("doc_id")


def query_terms(spark, terms: list[str]) -> DataFrame:
    """``(term, times)`` of a query; repeated terms count."""
    counted = {t: terms.count(t) for t in terms}
    return spark.createDataFrame([(t, n) for t, n in counted.items()], "term string, times long")


def search_or(post: DataFrame, terms: list[str]) -> DataFrame:
    """``(doc_id, matched)``: how many query tokens each document has, repeats included."""
    wanted = F.broadcast(query_terms(post.sparkSession, terms))  # as many rows as the query has words
    return post.filter(F.col("term").isin(sorted(set(terms)))).join(wanted, "term").groupBy("doc_id").agg(F.sum("times").alias("matched"))


def document_frequency(post: DataFrame, term: str) -> DataFrame:
    return post.filter(F.col("term") == term).agg(F.count("*").alias("df")).select(F.lit(term).alias("term"), "df")


def terms_sorted(post: DataFrame) -> DataFrame:
    return post.select("term").distinct().orderBy("term")


def add_documents(post: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings with those of new documents; a document that was there is replaced."""
    return post.join(docs.select("doc_id"), "doc_id", "left_anti").unionByName(postings(docs))
