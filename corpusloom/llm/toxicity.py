"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of ``SIZES`` characters (code points) of the text (A-Z lower-cased, white space
as space, one space on either side), hashed to ``2 ** BITS`` buckets. An occurrence counts with its bucket's
log-count ratio r = log((p / |p|) / (q / |q|)), p and q being the smoothed occurrences in toxic and other
training texts. A text's vector is divided by the root of the sum of r squared over its occurrences, so
that long and short texts compare. On these vectors a logistic regression over all buckets is fitted
(full-batch Adam, L2), in one executor task; the driver receives the model alone.

The fit uses labelled rows with crc32(id) mod 5 <> 0 only, at most ``TRAIN_ROWS`` of them (half of it for
each label, by least hash of the id) and, of these, rows by hash that together have at most ``TRAIN_FEATURES``
distinct buckets, counted by row: documented bounds on the fit alone. Every text is scored whole. Labels, languages and
sources are never inputs of a score.

Nulls and empty texts are scored like a single space. Rows with a null id are scored and counted as
held out by the crc32 of the empty string. Repeated rows get one output row each. Without labels of
both kinds every score is the share of toxic labels (near 0 without labels). A score of exactly 0.5 is
toxic. An empty table gives an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import spread, stored, table, texts, tidy

BITS = 18
SIZES = (3, 4, 5, 6)
#: Most labelled rows used for the fit, and most distinct buckets summed over them.
TRAIN_ROWS = 4000
TRAIN_FEATURES = 16_000_000
#: Entries of the training rows looked at together.
PART = 500_000
FOLDS = 5
#: Tasks that turn the labelled rows to features.
PARTS = 8
#: Characters of text turned to features at once.
PIECE = 1 << 17
_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F), np.uint32(0x165667B1), np.uint32(0x2C1B3C6D))
_PLAIN = str.maketrans({**{c: c + 32 for c in range(65, 91)}, **{c: 32 for c in range(9, 14)}})


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _slots(data: np.ndarray):
    """(n, bucket of the n-gram at each place) for each size."""
    part = data + np.uint32(1)
    h = part
    for n in range(2, max(SIZES) + 1):
        if len(h) < 2:
            return
        h = h[:-1] * _ODD[n % 6]
        h += part[n - 1 :]
        if n in SIZES:
            mixed = h ^ (h >> np.uint32(15))
            mixed *= _ODD[1]
            mixed >>= np.uint32(32 - BITS)
            yield n, mixed


def _pieces(texts_: list[str]):
    """(number of the first text, [(text, its share of places)]): whole texts together, long ones in parts that overlap."""
    over = max(SIZES) - 1
    first, held, size = 0, [], 0
    for i, text in enumerate(texts_):
        padded = f" {text.translate(_PLAIN)} "
        if size + len(padded) > PIECE and held:
            yield first, held
            first, held, size = i, [], 0
        at = 0
        while len(padded) - at > PIECE:
            yield i, [(padded[at : at + PIECE + over], PIECE)]
            at += PIECE
        held.append((padded[at:], len(padded) - at))
        size += len(padded) - at
    if held:
        yield first, held


@dataclass
class Model:
    """By bucket the weight (regression weight times log-count ratio) and the ratio squared; the intercept."""

    weight: np.ndarray
    square: np.ndarray
    bias: float

    def scores(self, texts_: list[str]) -> np.ndarray:
        total, norm = np.zeros(len(texts_)), np.zeros(len(texts_))
        for first, held in _pieces(texts_):
            lengths = np.array([len(x) for x, _ in held])
            begin = np.cumsum(lengths) - lengths
            starts = np.array([n for _, n in held])  # n-grams that start past this belong to the next part
            flat = _points("".join(x for x, _ in held))
            for n, slot in _slots(flat):
                upto = np.minimum(begin + np.minimum(starts, np.maximum(lengths - n + 1, 0)), len(slot))
                low = np.minimum(begin, len(slot))
                for out, values in ((total, self.weight), (norm, self.square)):
                    run = np.zeros(len(slot) + 1)
                    np.cumsum(values[slot], out=run[1:])
                    np.add.at(out, np.arange(first, first + len(held)), run[upto] - run[low])
        return 1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(norm, 1e-9)) + self.bias, -30, 30)))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and how often each occurs."""
    parts = []
    for _, held in _pieces([text]):
        data, starts = held[0]
        parts += [np.unique(slot[:starts], return_counts=True) for _, slot in _slots(_points(data))]
    found, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    counts = np.bincount(back, np.concatenate([p[1] for p in parts]) if parts else None, len(found))
    return found.astype(np.int32), np.minimum(counts, 1 << 30).astype(np.float32)


#: Training rows together: the number of entries of each row, and all their buckets and occurrences.
Part = tuple[np.ndarray, np.ndarray, np.ndarray]


def packed(rows: Iterable[tuple[np.ndarray, np.ndarray]], most: int = PART) -> list[Part]:
    """Rows in parts of about ``most`` entries; a row's own arrays are let go once its part is full."""
    parts, held, size = [], [], 0

    def close() -> None:
        parts.append((np.array([len(r[0]) for r in held]), np.concatenate([r[0] for r in held]), np.concatenate([r[1] for r in held])))
        held.clear()

    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= most:
            close()
            size = 0
    if held:
        close()
    return parts


def ratios(parts: list[Part], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log-count ratio of each bucket; 0 for those of no row."""
    counts, at = np.zeros((2, 1 << BITS)), 0
    for sizes, slots, times in parts:
        toxic = np.repeat(np.asarray(labels[at : at + len(sizes)], bool), sizes)
        at += len(sizes)
        counts += [np.bincount(slots, times * which, 1 << BITS) for which in (toxic, ~toxic)]
    p, q = counts + smooth
    return np.where(counts.any(axis=0), np.log((p / p.sum()) / (q / q.sum())), 0.0)


def constant(labels: np.ndarray) -> Model:
    size = 1 << BITS
    odds = np.clip(labels.mean() if len(labels) else 0.0, 1e-6, 1 - 1e-6)
    return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), float(np.log(odds / (1 - odds))))


def fit(parts: list[Part], labels: np.ndarray, rounds: int = 60, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Logistic regression on the rows' vectors; a vector is never written out: its ratios and norm act on weights and errors."""
    labels = np.asarray(labels, np.float64)
    if not 0 < labels.sum() < len(labels):
        return constant(labels)
    ratio = ratios(parts, labels).astype(np.float32)
    square = np.square(ratio)
    size = 1 << BITS
    norms = [np.sqrt(np.maximum(np.bincount(np.repeat(np.arange(len(n)), n), times * square[col], len(n)), 1e-9)) for n, col, times in parts]
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    weigh = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    for step in range(1, rounds + 1):
        g, gb, at = np.zeros(size), 0.0, 0
        plain = (w * ratio).astype(np.float32)
        for (n, col, times), norm in zip(parts, norms, strict=True):
            owner = np.repeat(np.arange(len(n)), n)
            z = np.bincount(owner, times * plain[col], len(n)) / norm + b
            miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[at : at + len(n)]) * weigh[at : at + len(n)]
            g += np.bincount(col, times * (miss / norm).astype(np.float32)[owner], size)
            gb += miss.sum()
            at += len(n)
        g = g * ratio + decay * w
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return Model((w * ratio).astype(np.float32), square, float(b))


def _fold(column: str):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on the documents whose label is known, at most ``train_rows`` of them, outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & (_fold("id") != 0)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    half = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(train_rows // 2) for k in (0, 1)]
    chosen = half[0].union(half[1])  # bounded by train_rows

    picked = spread(texts(docs, "doc_id", "text")).join(F.broadcast(chosen), "id").select("id", "text", "toxic")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(x or "") for x in b["text"].to_pylist()]
            sizes = pa.array([len(x[0]) for x in got], pa.int64())
            yield pa.RecordBatch.from_arrays([b["id"], b["toxic"], sizes, *(pa.array([x[k].tobytes() for x in got], pa.binary()) for k in (0, 1))], ["id", "toxic", "n", "slots", "times"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: list[int] = []

        def rows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            total = 0
            for b in batches:
                for k, (toxic, n) in enumerate(zip(b["toxic"].to_pylist(), b["n"].to_pylist(), strict=True)):
                    if total + n <= TRAIN_FEATURES:
                        total += n
                        labels.append(toxic)
                        yield np.frombuffer(b["slots"][k].as_py(), np.int32), np.frombuffer(b["times"][k].as_py(), np.float32)

        model = fit(packed(rows()), np.array(labels))
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()]), pa.array([model.square.tobytes()]), pa.array([model.bias])], ["weight", "square", "bias"])

    made = stored(picked.repartition(PARTS, "id").mapInArrow(tidy(read), "id long, toxic int, n long, slots binary, times binary"), "features")
    # train_rows rows at most come to the one task that fits
    one = made.coalesce(1).sortWithinPartitions(F.xxhash64("id"), "id", "n").mapInArrow(tidy(learn), "weight binary, square binary, bias double")
    got = stored(one, "model").first()
    if got is None:  # no labelled row at all
        return constant(np.zeros(0))
    return Model(np.frombuffer(got["weight"], np.float32), np.frombuffer(got["square"], np.float32), got["bias"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every whole text. The model (2 MB, whatever the data) is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = sent.value.scores([x or "" for x in b["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(scores, pa.float64())], ["id", "score"])

    return spread(texts(docs, id_col, text_col)).mapInArrow(tidy(run), "id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), (_fold("id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def nontoxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored under 0.5, with their columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = sent.value.scores([x or "" for x in b["text"].to_pylist()])
            yield b.filter(pa.array(scores < 0.5))

    return spread(docs).mapInArrow(tidy(run), schema)
