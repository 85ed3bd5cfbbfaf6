"""Exact top-k inner products by a bit-sliced index.

Components are quantised to floor(256 x). A block of rows is stored as bit slices: for each
attribute its values, shifted to start at 0, as one bitmap per bit. A block of queries is scored
with bitmap arithmetic alone: for each query and attribute the slices (complemented for a negative
weight) are added, shifted by each set bit of the weight, into the slices of the sums. From the most
significant slice downward the rows surely in the top k and those still tied are kept apart; what
is tied at the last slice has one score, and the smaller ids are taken. Blocks' winners are merged exactly.

The stated queries meet all rows in blocks, on a grid of tasks: row blocks are dealt to its columns, query blocks
to its rows, and both are copied along the other side only. Its shape makes these copies fewest.

Vectors null, empty, or holding null or non-finite components, and rows with a null id, take no
part. Vectors of another length than the query's are no candidates. A query's own row is the one
with its id (repeated ids are all left out); repeated query rows are one query. Ties go to the
smaller id. Components so large that a score may not fit a long raise an error. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, spread, stored, table, tidy

SCALE = 256
TOP = 5
QUERY_STEP = 50
ROW_BLOCK = 4096
QUERY_BLOCK = 64
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bitmaps [attribute, bit, word], least value of each attribute) of integer rows [row, attribute]."""
    least = values.min(axis=0)
    shifted = (values - least).astype(np.uint64)
    bits = max(1, int(shifted.max()).bit_length())
    words = -(-len(values) // 64)
    out = np.zeros((values.shape[1], bits, words), np.uint64)
    for b in range(bits):
        on = ((shifted >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T
        packed = np.packbits(np.pad(on, ((0, 0), (0, words * 64 - len(values)))), axis=1, bitorder="little")
        out[:, b] = np.ascontiguousarray(packed).view("<u8")
    return out, least


def sums(index: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Slices [bit, query, word] of sum(|w| * (x or its complement)) for each query's weights [query, attribute]."""
    dims, bits, words = index.shape
    top = int(np.abs(weights).max()).bit_length()
    total = max(1, (dims * ((1 << bits) - 1) * max(1, int(np.abs(weights).max()))).bit_length())
    acc = np.zeros((total, len(weights), words), np.uint64)
    high = 0  # slices in use
    size = np.abs(weights).astype(np.uint64)
    for d in range(dims):
        flip = np.where(weights[:, d] < 0, _ALL, np.uint64(0))[:, None]
        term = [index[d, b][None, :] ^ flip for b in range(bits)]
        for j in range(top):
            mask = (np.uint64(0) - ((size[:, d] >> np.uint64(j)) & np.uint64(1)))[:, None]
            if not mask.any():
                continue
            carry = None
            for b in range(bits):
                x, s = term[b] & mask, acc[j + b]
                both = s ^ x
                if carry is None:  # s is a view: the carry comes first
                    carry = s & x
                    acc[j + b] = both
                else:
                    onward = (s & x) | (both & carry)
                    acc[j + b] = both ^ carry
                    carry = onward
            at = j + bits
            high = max(high, at)
            while at < total and carry.any():
                s = acc[at]
                acc[at], carry = s ^ carry, s & carry
                at += 1
            high = max(high, at)
    return acc[:high]


def winners(acc: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps [query, word] of the rows surely in the top k, and of those tied at its boundary."""
    sure = np.zeros_like(valid)
    tied = valid.copy()
    for s in acc[::-1]:
        hit = tied & s
        n = np.bitwise_count(sure).sum(axis=1, dtype=np.int64) + np.bitwise_count(hit).sum(axis=1, dtype=np.int64)
        over = (n > k)[:, None]
        sure = np.where(over, sure, sure | hit)
        tied = np.where(over, hit, tied & ~s)
    return sure, tied


def _first_bits(row: np.ndarray, most: int) -> list[int]:
    out: list[int] = []
    for w in np.flatnonzero(row):
        x = int(row[w])
        while x and len(out) < most:
            out.append(int(w) * 64 + (x & -x).bit_length() - 1)
            x &= x - 1
        if len(out) >= most:
            break
    return out


def _blocks(size: int, index: bool):
    """Rows (id, v array<int>) to blocks of one dimension: (dim, salt, n, ids, data, bits, least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[int, list] = {}
        made = 0

        def put(dim: int) -> pa.RecordBatch:
            nonlocal made
            rows = sorted(held.pop(dim), key=lambda r: r[0])
            ids = np.array([r[0] for r in rows], np.int64)
            values = np.stack([r[1] for r in rows])
            data, least = slices(values) if index else (values, np.zeros(0, np.int64))
            made += 1
            cols = [[dim], [part * 7919 + made], [len(rows)], [ids.tobytes()], [data.tobytes()], [data.shape[1] if index else 0], [least.tobytes()]]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["dim", "salt", "n", "ids", "data", "bits", "least"])

        for b in batches:
            for k, v in zip(b["id"].to_pylist(), b["v"], strict=True):
                v = v.values.to_numpy()
                held.setdefault(len(v), []).append((k, v))
                if len(held[len(v)]) >= size:
                    yield put(len(v))
        for dim in sorted(held):
            yield put(dim)

    return run


_BLOCK = "dim int, salt long, n int, ids binary, data binary, bits int, least binary"


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for r in b.to_pylist():
                dim = r["dim"]
                ids, asked = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                index = np.frombuffer(r["data"], np.uint64).reshape(dim, r["bits"], -1)
                weights = np.frombuffer(r["q_data"], np.int64).reshape(-1, dim)
                least = np.frombuffer(r["least"], np.int64)
                acc = sums(index, weights)
                words = index.shape[2]
                valid = np.zeros((len(asked), words * 64), np.uint8)
                valid[:, : len(ids)] = 1
                own = np.searchsorted(ids, asked)
                for q, p in enumerate(own):
                    while p < len(ids) and ids[p] == asked[q]:
                        valid[q, p] = 0
                        p += 1
                sure, tied = winners(acc, np.ascontiguousarray(np.packbits(valid, axis=1, bitorder="little")).view("<u8"), k)
                top = (1 << r["bits"]) - 1
                # what shifting and complementing added to every row of a query
                shift = weights @ least + np.where(weights < 0, weights, 0).sum(axis=1) * top
                for q in range(len(asked)):
                    rows = _first_bits(sure[q], k)
                    rows += _first_bits(tied[q], k - len(rows))
                    for i in rows:
                        w, bit = divmod(i, 64)
                        got = acc[:, q, w] >> np.uint64(bit) & np.uint64(1)
                        out[0].append(int(asked[q]))
                        out[1].append(int(ids[i]))
                        out[2].append(sum(int(x) << n for n, x in enumerate(got)) + int(shift[q]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    return run


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, v array<long>)`` of the vectors that take part."""
    x = F.col(vector_col)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    # below this no sum of products passes 2 ** 62
    most = F.sqrt(F.lit(2.0**62) / F.size(x))
    whole = lambda e: F.when(F.abs(e.cast("double") * SCALE) < most, F.floor(e.cast("double") * SCALE).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for scores of 64 bits")).cast("long"))
    return vectors.filter(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; vectors and queries are ``(id, v array<long>)``."""
    spark = vectors.sparkSession
    batches_of(spark, 64)
    index = stored(spread(vectors).mapInArrow(_blocks(ROW_BLOCK, True), _BLOCK), "slices")
    asked = stored(spread(queries.dropDuplicates(["id"])).mapInArrow(_blocks(QUERY_BLOCK, False), _BLOCK), "asked")
    n_rows, n_asked = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (index, asked))
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    down = max(1, round(sqrt(tasks * n_asked / max(1, n_rows))))  # copies of a row block
    across = max(1, tasks // down)  # copies of a query block
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cells = ["dim", "x", "y"]  # an explicit number: blocks are few and small, and take long
    left = index.withColumn("x", F.pmod("salt", F.lit(across))).withColumn("y", every(down)).repartition(across * down, *cells)
    right = asked.select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.pmod("salt", F.lit(down)).alias("y"), every(across).alias("x")).repartition(across * down, *cells)
    found = left.join(right, cells).mapInArrow(tidy(_search(k)), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("id") % QUERY_STEP == 0))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
