"""Sources and sinks: manifests, files, Parquet tables, JSON and CSV."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from urllib.parse import quote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.sources import tables


def manifest_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a manifest (tab-separated, # for comments, no quoting), with an id, a name, a path and a format."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line")).filter("trim(line) <> '' AND NOT startswith(line, '#')")
    field = lambda k: F.get(F.split("line", "\t"), k)
    rows = lines.select(field(0).try_cast("long").alias("doc_id"), field(1).alias("name"), field(2).alias("path"), field(3).alias("format"), F.coalesce(field(4).try_cast("long"), F.lit(0)).alias("size_bytes"))
    return rows.filter("doc_id >= 0 AND name <> '' AND path <> '' AND format IS NOT NULL")


def _read_files(default: str):
    """Rows with ``path`` to rows with ``text``; files that are missing or cannot be read fall out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, path in enumerate(b["path"].to_pylist()):
                try:
                    # a bare path is no URI: its spaces, quotes and percent signs stand for themselves
                    where = path if "://" in path else f"{default}{quote(path)}" if default else path
                    fs, name = pafs.FileSystem.from_uri(where) if "://" in where else (pafs.LocalFileSystem(), os.path.abspath(where))
                    with fs.open_input_file(name) as f:
                        text = f.read().decode("utf-8", "replace")
                except (OSError, pa.ArrowInvalid):
                    continue
                yield pa.RecordBatch.from_arrays([*b.slice(k, 1).columns, pa.array([text], pa.string())], [*b.schema.names, "text"])

    return run


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a manifest; missing, empty and malformed ones fall out. Only the listed files are read, by the tasks."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/")
    rows = manifest_rows(spark, path)
    rows = rows.repartition(spark.sparkContext.defaultParallelism) if rows.rdd.getNumPartitions() == 1 else rows
    read = rows.mapInArrow(_read_files("" if default.startswith("file:") else default), StructType([*rows.schema.fields, StructField("text", StringType())]))
    return read.filter("text <> ''").select("doc_id", "name", "path", "format", "text", "size_bytes")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with ``number``, from 0 in the order of some columns: sorted in ranges, which are counted and shifted; no single task."""
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__cl_at", F.monotonically_increasing_id())
    at = tables.stored(at, "numbered")
    part = F.shiftright("__cl_at", 33)
    counts = at.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(counts.select("part", before.alias("before")))
    return at.withColumn("part", part).join(shifts, "part").withColumn("number", F.col("before") + F.col("__cl_at").bitwiseAND((1 << 33) - 1)).drop("part", "before", "__cl_at")


def manifest_of(paths: DataFrame) -> DataFrame:
    """Manifest rows of ``(name, path)``: ids 1 to n in path order, format txt, size 0."""
    at = numbered(paths.select("name", "path"), "path", "name")
    return at.select((F.col("number") + 1).alias("doc_id"), "name", "path", F.lit("txt").alias("format"), F.lit(0).cast("long").alias("size_bytes"))


def write_manifest(paths: DataFrame, out: str) -> DataFrame:
    """Write the manifest of ``(name, path)`` rows; a name with a tab or line end would break its line, so these become spaces."""
    rows = manifest_of(paths)
    plain = [F.regexp_replace(F.col(c), "[\t\r\n]", " ") if c == "name" else F.col(c).cast("string") for c in rows.columns]
    rows.select(F.concat_ws("\t", *plain).alias("value")).write.mode("overwrite").text(out)
    return rows


def docx_text(data: bytes) -> str:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def pdf_text(data: bytes) -> str:
    import pypdf  # optional

    return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages)


def extract(files: DataFrame) -> DataFrame:
    """``(path, text, error)`` from a binaryFile scan: txt, docx and (with pypdf) pdf; others have an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {"txt": lambda b: b.decode("utf-8", "replace"), "docx": docx_text, "pdf": pdf_text}
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append((path, readers[path.rsplit(".", 1)[-1].lower()](content), None))
                except Exception as e:  # a bad file is reported in its row
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def demo_corpus(spark: SparkSession, n: int) -> DataFrame:
    """n (10 to 100) documents of three short texts in turn."""
    if not 10 <= n <= 100:
        raise ValueError("from 10 to 100 documents")
    text = (
        F.when(F.col("id") % 3 == 0, "Engines count words over many machines. Partial sums travel, documents stay.")
        .when(F.col("id") % 3 == 1, "An index maps terms to documents. Searching reads few of its rows.")
        .otherwise("Weights tell rare terms from common ones. Similar vectors point to similar texts.")
    )
    return spark.range(1, n + 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("demo_"), "id").alias("name"), text.alias("text"))


def upsert(old: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return new if old is None else old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def append_history(spark: SparkSession, path: str, documents: int, millis: float, processes: int, at: str | None = None) -> None:
    """Add a run to the history; ``at`` is its time (now, if none is given)."""
    row = spark.createDataFrame([(documents, float(millis), processes)], "docs_processed long, time_ms double, processes int")
    row.withColumn("at", F.lit(at).cast("timestamp") if at else F.current_timestamp()).write.mode("append").parquet(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("at"))


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def clear(spark: SparkSession, path: str, root: str) -> bool:
    """Delete an output folder, only inside ``root``."""
    if not path.rstrip("/").startswith(root.rstrip("/") + "/") or ".." in path:
        raise ValueError(f"{path} is not inside {root}")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def summary_of(docs: DataFrame) -> DataFrame:
    """Metadata of all documents; the text is pruned at the scan."""
    return docs.drop("text")


def lookup(docs: DataFrame, doc_id: int) -> DataFrame:
    """The documents of an id; the filter reaches the scan."""
    return docs.filter(F.col("doc_id") == doc_id)


def content_of(docs: DataFrame, doc_id: int) -> str:
    """The text of a document, empty where there is none."""
    row = lookup(docs, doc_id).select("text").first()
    return (row["text"] or "") if row else ""


def trend(runs: DataFrame) -> DataFrame:
    """``(at, processes, time_ms)`` of the history, oldest first."""
    return runs.select("at", "processes", "time_ms").orderBy("at", "processes")
