"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import shared_dir


def folder_of(spark: SparkSession) -> str:
    """The session's folder for intermediate tables, in the shared folder."""
    return f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}"


#: The tables of the scope that is open, and of each scope's last use.
_open: list[list[str]] = []
_left: dict[str, list[str]] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{folder_of(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Delete the session's intermediate tables; whoever has written the last result calls it."""
    _delete(spark, folder_of(spark))


def collect_heaps(spark: SparkSession) -> None:
    """Collect garbage in each executor: a JVM keeps the heap that its busiest stage took until a full collection.

    A task for each core; while no other job runs, these reach all executors.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


@contextlib.contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """Delete the intermediate tables of this scope's last use, whose result has been written since, and note those made now.

    Collecting garbage lets Spark delete the shuffles that nothing refers to any more, and executors give back what
    the stage before has taken, which the Python workers of this one may need.
    """
    for path in _left.pop(name, []):
        _delete(spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    collect_heaps(spark)
    _open.append(made := [])
    try:
        yield
    finally:
        _open.remove(made)
        _left[name] = made


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan with fewer splits than cores out evenly; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def keyed(docs: DataFrame) -> DataFrame:
    """``docs``, stored, with a row key ``__cl_row``; ids may be null or repeat."""
    return stored(docs.withColumn("__cl_row", F.monotonically_increasing_id()), "keyed")


#: A key is hot with more than 1 / HOT of all rows, so there are under HOT hot keys.
HOT = 1000
SALTS = 64


def hot_join(rows: DataFrame, by_key: DataFrame, key: str, times: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``by_key`` (a row per key, ``times`` of its rows of ``total``) that splits hot keys.

    Only the hot keys are broadcast, under ``HOT`` of them at any size of the input; their rows are
    dealt over ``SALTS`` tasks. All other keys join as usual.
    """
    is_hot = F.col(times) > max(total // HOT, SALTS)
    hot = by_key.filter(is_hot).select(key, F.lit(True).alias("__cl_hot"))
    salt = F.when(F.col("__cl_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("__cl_salt", salt).drop("__cl_hot")
    dealt = by_key.withColumn("__cl_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(dealt, [key, "__cl_salt"]).drop("__cl_salt")


#: Keys that are broadcast at most (8 bytes each).
FEW = 1 << 20


def chosen(rows: DataFrame, ids: DataFrame, key: str, out: bool = False) -> DataFrame:
    """The rows whose ``key`` is among ``ids`` (a row for each key), or is not (``out``).

    The keys are counted: up to ``FEW`` are broadcast, so that the rows, which may hold long texts, are not
    shuffled; more are met by an ordinary join.
    """
    ids = ids.select(key)
    if ids.count() <= FEW:
        ids = F.broadcast(ids)
    return rows.join(ids, key, "left_anti" if out else "left_semi")


#: Most rows and bytes of one Arrow batch, so that long texts do not swell the Python workers.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def batches_of(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of the plans that follow by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id long, text string)`` with nulls in the text as empty; other columns are pruned at the scan."""
    batches_of(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def give_back() -> None:
    """Return freed memory to the system, so that an idle Python worker does not hold what its last task took."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over Arrow batches that gives memory back at its end."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string or binary column without copying."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]] if len(offsets) else flat, offsets - offsets[0]
