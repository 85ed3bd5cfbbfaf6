"""A corpus's index as stored tables: tokenised once, read by every query.

``save`` writes, under a folder of its own for each generation:

* ``by_doc``: ``(doc_id, term, tf, most)``, most being the document's greatest count;
* ``vocabulary``: ``(term, cf, df)``, sorted by term;
* ``by_term``: ``(doc_id, term, tf, most, df)``, in ranges of terms and sorted, so that a search reads only its
  terms' row groups, and TF-IDF weights are a projection without a join or window;
* ``documents``: ``(doc_id, doc_name, total, unique_terms)``, those without tokens too.

A generation counts only once its ``ready`` table is written, so a run that dies leaves the one before.
"""

from __future__ import annotations

import atexit
import gc
import hashlib
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import index, weights

NAMES = ("by_doc", "vocabulary", "by_term", "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; on a local master without one, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """Write ``df`` in the shared folder and read it back; with a key in buckets, so that joins on it do not shuffle it."""
    spark = df.sparkSession
    run = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/corpusloom/{name}-{run}"
    if key is not None:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(buckets, key).option("path", path).saveAsTable(f"corpusloom_{name}_{run}", format="parquet")
        return spark.table(f"corpusloom_{name}_{run}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *done: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; collecting garbage lets Spark delete the shuffles that nothing refers to."""
    for df in done:
        for file in df.inputFiles()[:1]:
            fs, where = _files(spark, file)
            fs.delete(where.getParent(), True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@dataclass(frozen=True)
class Tables:
    """The stored tables, and the number of documents."""

    by_doc: DataFrame
    vocabulary: DataFrame
    by_term: DataFrame
    documents: DataFrame
    count: int

    @property
    def postings(self) -> DataFrame:
        return self.by_doc.select("doc_id", "term", "tf")

    @property
    def weights(self) -> DataFrame:
        """``(doc_id, term, tf, tfidf, df)``: a projection of ``by_term``; a filter on terms reaches its scan."""
        score = weights.tf(F.col("tf"), F.col("most")) * weights.idf(F.lit(self.count), F.col("df"))
        return self.by_term.select("doc_id", "term", "tf", score.alias("tfidf"), "df")

    @property
    def totals(self) -> DataFrame:
        return self.documents.withColumn("density", T.density(F.col("unique_terms"), F.col("total")))


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _generations(spark: SparkSession, path: str) -> list[int]:
    fs, where = _files(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[4:]) for n in names if n.startswith("gen-") and fs.exists(_files(spark, f"{path}/{n}/ready/_SUCCESS")[1]))


def _write(spark: SparkSession, post: DataFrame, names: DataFrame, path: str) -> Tables:
    """``post`` is ``(doc_id, term, tf)`` by document, ``names`` is ``(doc_id, doc_name)``, a row for each document."""
    done = _generations(spark, path)
    folder = f"{path}/gen-{(done[-1] if done else 0) + 1}"
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}")
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    write(post.select("doc_id", "term", "tf", F.max("tf").over(Window.partitionBy("doc_id")).alias("most")), "by_doc")
    by_doc = read("by_doc")
    write(index.vocabulary(by_doc).repartitionByRange("term").sortWithinPartitions("term"), "vocabulary")
    joined = by_doc.join(read("vocabulary").select("term", "df"), "term").select("doc_id", "term", "tf", "most", "df")
    write(joined.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"), "by_term")
    counted = by_doc.groupBy("doc_id").agg(F.sum("tf").alias("total"), F.count("*").alias("unique_terms"))
    write(names.join(counted, "doc_id", "left").na.fill(0, ["total", "unique_terms"]), "documents")
    write(read("documents").agg(F.count("*").alias("n")), "ready")
    return load(spark, path)


def save(docs: DataFrame, path: str) -> Tables:
    """Tokenise documents ``(doc_id, doc_name, text)`` once and store the tables."""
    return _write(docs.sparkSession, index.postings(docs), docs.select("doc_id", "doc_name"), path.rstrip("/"))


def load(spark: SparkSession, path: str) -> Tables:
    """The newest whole generation under a folder."""
    path = path.rstrip("/")
    done = _generations(spark, path)
    if not done:
        raise FileNotFoundError(f"no index in {path}")
    read = [spark.read.parquet(f"{path}/gen-{done[-1]}/{n}") for n in (*NAMES, "ready")]
    return Tables(*read[:-1], read[-1].first()["n"])


def is_index(spark: SparkSession, path: str) -> bool:
    return bool(_generations(spark, path.rstrip("/")))


def upsert(spark: SparkSession, path: str, docs: DataFrame) -> Tables:
    """A generation in which ``docs`` replace the documents of their ids; only they are tokenised, and no old posting of theirs stays."""
    old = load(spark, path)
    ids = docs.select("doc_id").distinct()
    post = old.postings.join(ids, "doc_id", "left_anti").unionByName(index.postings(docs))
    names = old.documents.select("doc_id", "doc_name").join(ids, "doc_id", "left_anti").unionByName(docs.select("doc_id", "doc_name"))
    return _write(spark, post, names, path.rstrip("/"))


_known: dict[str, Tables] = {}


def of(spark: SparkSession, path: str, **columns: str) -> Tables:
    """The tables of a Parquet table of documents, built at the first call of a session and again when its files change."""
    fs, where = _files(spark, path)
    files, found = fs.listFiles(where, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    seen = hashlib.sha256("\n".join([spark.sparkContext.applicationId, *sorted(found), *map(str, sorted(columns.items()))]).encode()).hexdigest()
    if seen not in _known:
        folder = f"{shared_dir(spark)}/corpusloom/index-{seen[:16]}-{uuid.uuid4().hex}"
        _known[seen] = save(index.corpus(spark.read.parquet(path), **columns), folder)
    return _known[seen]
