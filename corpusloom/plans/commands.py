"""The five batch commands over a corpus, each writing its results as a folder of JSON tables.

A result that grows with the corpus is a table written by the tasks, never a document built on the
driver; the one-row ``summary`` holds the totals.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import analytics, index, search, similarity, weights
from corpusloom.sources import io, tables


def load(spark: SparkSession, path: str) -> DataFrame:
    """Documents ``(doc_id, doc_name, text)`` of a Parquet table or of a manifest."""
    if path.rstrip("/").endswith(".parquet"):
        return index.corpus(spark.read.parquet(path))
    rows = io.read_manifest(spark, path)
    return rows.select("doc_id", F.col("name").alias("doc_name"), "text")


def indexed(spark: SparkSession, corpus: str) -> tables.Tables:
    """The stored index a command was given (``process`` writes one), or one made of the given documents for this run."""
    if tables.is_index(spark, corpus):
        return tables.load(spark, corpus)
    return tables.save(load(spark, corpus), f"{tables.shared_dir(spark)}/corpusloom/index-{uuid.uuid4().hex}")


def _write(results: dict[str, DataFrame], out: str) -> None:
    for name, table in results.items():
        io.write_json(table, f"{out.rstrip('/')}/{name}")


def _summary(spark: SparkSession, command: str, began: float, **more) -> DataFrame:
    values = {"command": command, "processing_time_ms": round((time.time() - began) * 1000, 2), "num_processes": spark.sparkContext.defaultParallelism, **more}
    return spark.createDataFrame([tuple(values.values())], list(values))


def process(spark: SparkSession, corpus: str, out: str) -> dict[str, DataFrame]:
    """Totals, the 50 top words, the 200 top counts, the 50 top words of each document, the inverted index and the history.

    The documents are tokenised once, into the index under ``index``; the other commands take that folder as
    their corpus, and do not tokenise again.
    """
    began = time.time()
    kept = tables.save(load(spark, corpus), f"{out.rstrip('/')}/index")
    results = {
        "totals": index.corpus_totals(kept.documents, kept.vocabulary),
        "documents": kept.totals,
        "top_words": index.top_words(kept.vocabulary),
        "global_word_counts": index.top_counts(kept.vocabulary),
        "per_doc_counts": index.top_terms_per_doc(kept.postings),
        "inverted_index": index.inverted(kept.postings),
    }
    _write(results, out)
    millis = (time.time() - began) * 1000
    io.append_history(spark, f"{out.rstrip('/')}/history", kept.count, millis, spark.sparkContext.defaultParallelism)
    _write({"summary": _summary(spark, "process", began, total_documents=kept.count)}, out)
    return results


def tfidf(spark: SparkSession, corpus: str, out: str) -> dict[str, DataFrame]:
    """The 20 best scores and the 10 keywords of each document, and document frequencies."""
    began = time.time()
    kept = indexed(spark, corpus)
    best = tables.stored(weights.keywords(kept.weights, 20), "keywords")
    named = best.filter("rank <= 10").join(kept.documents.select("doc_id", "doc_name"), "doc_id")
    results = {"tfidf_scores": best, "keywords": named, "document_frequencies": kept.vocabulary.select("term", "df")}
    _write(results, out)
    _write({"summary": _summary(spark, "tfidf", began)}, out)
    return results


def find(spark: SparkSession, corpus: str, out: str, query: str) -> dict[str, DataFrame]:
    """The ranked documents of a query; of a stored index only the query's terms are read."""
    began = time.time()
    kept = indexed(spark, corpus)
    results = {"results": search.search(kept.weights, kept.documents, query)}
    _write(results, out)
    _write({"summary": _summary(spark, "search", began, query=query, num_results=spark.read.json(f"{out.rstrip('/')}/results").count())}, out)
    return results


def alike(spark: SparkSession, corpus: str, out: str) -> dict[str, DataFrame]:
    """Classes with their links, pairs of class representatives from 0.9, the ten most similar pairs, graph and clusters."""
    began = time.time()
    kept = indexed(spark, corpus)
    members = tables.stored(similarity.classes(kept.postings), "classes")
    vectors = tables.stored(similarity.representatives(similarity.unit(kept.weights), members), "vectors")
    ids = kept.documents.filter("total > 0")
    top = tables.stored(similarity.top_similar(vectors, members), "top")
    results = {
        "doc_ids": ids.select("doc_id", "doc_name"),
        "matrix": similarity.matrix(vectors),
        "top_similar": top,
        "duplicates": similarity.above(vectors),
        "members": similarity.link_counts(vectors, members),
        "edges": analytics.graph_edges(top),
        "nodes": analytics.graph_layout(ids),
        "clusters": analytics.star_clusters(top, ids),
    }
    _write(results, out)
    _write({"summary": _summary(spark, "similarity", began, num_documents=kept.count)}, out)
    return results


def benchmark(spark: SparkSession, corpus: str, out: str) -> dict[str, DataFrame]:
    """The word count in one task and in as many as there are cores: times, speedup, efficiency and overhead."""
    began = time.time()
    docs = load(spark, corpus)
    cores = spark.sparkContext.defaultParallelism

    def millis(parts: int) -> float:
        vocabulary = index.vocabulary(index.postings(docs.coalesce(1) if parts == 1 else docs.repartition(parts, "doc_id")))
        start = time.time()
        vocabulary.write.format("noop").mode("overwrite").save()
        return (time.time() - start) * 1000

    millis(cores)  # warm-up
    runs = spark.createDataFrame([(cores, millis(1), millis(cores))], "processes int, sequential_ms double, parallel_ms double")
    results = {"benchmark": runs.join(analytics.speedup(runs), "processes"), "totals": index.corpus_totals(docs)}
    _write(results, out)
    _write({"summary": _summary(spark, "benchmark", began)}, out)
    return results


COMMANDS = {"process": process, "tfidf": tfidf, "search": find, "similarity": alike, "benchmark": benchmark}


def run(spark: SparkSession, command: str, corpus: str, out: str, *query: str) -> dict[str, DataFrame]:
    """``corpus`` is a Parquet table, a manifest or (but for process and benchmark) a stored index; ``query`` is for search only."""
    if command not in COMMANDS:
        raise ValueError(f"no command {command}; there are {', '.join(COMMANDS)}")
    if bool(query) != (command == "search"):
        raise ValueError("search takes a query, the other commands take none")
    return COMMANDS[command](spark, corpus, out, *query)
