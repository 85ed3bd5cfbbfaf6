"""Corpus analytics over keywords, totals and pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources import io


def doc_profiles(totals: DataFrame, keys: DataFrame) -> DataFrame:
    """Document totals with density, diversity and keywords in order."""
    listed = keys.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term", "score"))).alias("k"))
    return totals.join(listed, "doc_id", "left").select("doc_id", F.coalesce("doc_name", F.lit("Unknown")).alias("doc_name"), "total", "unique_terms", F.round("density", 6).alias("density"), F.round("density", 6).alias("diversity"), F.coalesce(F.array_join("k.term", ","), F.lit("")).alias("keywords"))


def importance(weights: DataFrame) -> DataFrame:
    """``(doc_id, importance)``: unique terms plus the sum of weights."""
    return weights.groupBy("doc_id").agg(F.round(F.count("*") + F.sum("tfidf"), 4).alias("importance"))


def insights(docs: DataFrame, keys: DataFrame, n: int = 5) -> DataFrame:
    """Each document's first keywords and a preview of its text."""
    listed = keys.filter(F.col("rank") <= n).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("k"))
    return docs.join(listed, "doc_id").select("doc_id", F.array_join("k.term", ", ").alias("topics"), T.preview(F.col("text")).alias("preview"))


def detect_topics(keys: DataFrame, per_doc: int = 5, most: int = 10, shared: int = 2) -> DataFrame:
    """Greedy topics over the documents' keywords, in doc_id order.

    The lowest document without a topic starts one; later documents join if they share two keywords
    with the topic's growing set. The pass depends on its order, so it runs in one task, over at most
    five short strings a document.
    """

    def run(frames):
        rows = pd.concat(frames) if frames is not None else pd.DataFrame()
        words = {int(k): set(g) for k, g in rows.groupby("doc_id")["term"]} if len(rows) else {}
        taken: set[int] = set()
        out = []
        for seed in sorted(words):
            if len(out) >= most:
                break
            if seed in taken:
                continue
            topic, members = set(words[seed]), [seed]
            taken.add(seed)
            for other in sorted(words):
                if other not in taken and len(words[other] & topic) >= shared:
                    members.append(other)
                    taken.add(other)
                    topic |= words[other]
            chosen = sorted(topic, key=lambda w: w.encode())[:10]
            out.append((len(out), chosen, members, float(len(members) * len(chosen))))
        frame = pd.DataFrame(out, columns=["topic_id", "keywords", "doc_ids", "coherence"])
        yield frame.sort_values(["coherence", "topic_id"], ascending=[False, True])

    few = keys.filter(F.col("rank") <= per_doc).select("doc_id", "term").coalesce(1)
    return few.mapInPandas(lambda it: run(list(it) or None), "topic_id long, keywords array<string>, doc_ids array<long>, coherence double")


def graph_edges(top: DataFrame, least: float = 0.1) -> DataFrame:
    return top.filter(F.col("similarity") > least)


def graph_layout(ids: DataFrame) -> DataFrame:
    """Nodes on the unit circle, in doc_id order, numbered without a single task."""
    ids = io.numbered(ids.select("doc_id"), "doc_id")
    n = ids.agg(F.count("*").alias("n")).scalar()
    angle = 2 * F.pi() * F.col("number") / n
    return ids.select("doc_id", F.round(F.cos(angle), 6).alias("x"), F.round(F.sin(angle), 6).alias("y"))


def star_clusters(top: DataFrame, ids: DataFrame, least: float = 0.3) -> DataFrame:
    """``(cluster_id, doc_id)``: one greedy pass, in doc_id order, from each unvisited document to its unvisited partners.

    Only the top pairs link documents (ten rows at most, handled on the driver); all other documents
    are clusters of their own. A cluster is named by its first document.
    """
    links: dict[int, list[int]] = {}
    for r in top.filter(F.col("similarity") > least).collect():
        links.setdefault(r["doc_id_1"], []).append(r["doc_id_2"])
        links.setdefault(r["doc_id_2"], []).append(r["doc_id_1"])
    home: dict[int, int] = {}
    for start in sorted(links):
        if start not in home:
            home[start] = start
            for other in links[start]:
                home.setdefault(other, start)
    linked = top.sparkSession.createDataFrame([(c, d) for d, c in home.items()], "cluster_id long, doc_id long")
    alone = ids.select("doc_id").join(F.broadcast(linked), "doc_id", "left_anti").select(F.col("doc_id").alias("cluster_id"), "doc_id")
    return linked.unionByName(alone)


def kpis(totals: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Documents, words, the sum of the documents' unique terms, and the time of the latest run (null without a history)."""
    latest = F.lit(None).cast("double") if runs is None else runs.agg(F.max_by("time_ms", "at").alias("t")).scalar()
    return totals.agg(F.count("*").alias("documents"), F.coalesce(F.sum("total"), F.lit(0)).alias("words"), F.coalesce(F.sum("unique_terms"), F.lit(0)).alias("unique_sum")).withColumn("latest_ms", latest)


def speedup(runs: DataFrame) -> DataFrame:
    """Speedup, efficiency, overhead and clamped progress from ``(processes, sequential_ms, parallel_ms)``."""
    ratio = F.when(F.col("parallel_ms") > 0, F.col("sequential_ms") / F.col("parallel_ms"))
    each = ratio / F.col("processes")
    return runs.select("processes", F.round(ratio, 4).alias("speedup"), F.round(each, 4).alias("efficiency"), F.round(F.col("parallel_ms") * F.col("processes") - F.col("sequential_ms"), 4).alias("overhead_ms"), F.round(F.least(F.greatest(each, F.lit(0.0)), F.lit(1.0)), 4).alias("progress"))


def named_like(docs: DataFrame, pattern: str) -> DataFrame:
    return docs.filter(F.col("doc_name").rlike(f"(?i){pattern}"))


def viewer(docs: DataFrame, name: str) -> DataFrame:
    """The document of a name (the least id of several)."""
    return docs.filter(F.col("doc_name") == name).orderBy("doc_id").limit(1)
