"""SimHash near-duplicate groups, linked by BK-trees over shards of fingerprints.

1. Each text becomes a 64-bit fingerprint (majority bits of XXH64 over word shingles).
2. Equal fingerprints collapse to one. Of ``radius + 1`` bit blocks two fingerprints within the radius
   agree on at least one (of ``radius + 2`` blocks on two), so each goes to one shard for every block, or
   pair of blocks (pigeonhole; exact, no link is lost). A shard's key has as many bits of a block as
   leave about ``SHARD`` fingerprints in it.
3. Each shard is grown into a BK-tree, stored as arrays: a node's children are keyed by their integer
   Hamming distance to it. A shard of over ``block`` fingerprints has several trees, and each is searched for
   the fingerprints of all. Searches follow only edges within the radius. The trees hold every fingerprint
   and grow with the data, so they lie in the shared folder and go to the tasks by shard, never
   through the driver.
4. A search yields a spanning star for each component it finds (never all pairs); alternating
   large-star/small-star rounds join the stars to global components. Shards, vertices and fingerprints with
   a large part of all rows are salted in every join.

Nulls and texts without words have fingerprint zero and are linked like any other. Repeated rows
and equal ids keep one output row each. An empty table gives an empty result. Other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import chosen, hot_join, keyed, spread, stored, table, texts, tidy

RADIUS = 3
SHINGLE = 3
#: Fingerprints of a shard, about, and most of one tree, about.
SHARD = 256
BLOCK = 4096
#: Near copies of the pipeline's stage: word shingles, their least similarity, and the min-hashes for candidates.
NEAR_SHINGLE = 5
SIMILAR = 0.8
BANDS = 32
BAND_ROWS = 5
#: Min-hashes that estimate a pair's similarity; the bands use the first of them.
SKETCH = 320
_MULTIPLY = np.random.default_rng(6).integers(0, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
#: Part of equal min-hashes under which a pair is not looked at: three standard deviations below 0.8, so one pair in
#: about 1,000 of those at just 0.8 has less, and far fewer of the more similar ones.
LIKELY = 0.73
#: Rows of one key that a task compares with one another, about.
GROUP = 512
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority SimHash of one UTF-8 text, unsigned."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly space and \t to \r
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, n)
    planes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if n < 64:
        counts = _BITS[planes].sum(axis=0)
    else:
        counts = np.stack([np.bincount(planes[:, k], minlength=256) @ _BITS for k in range(8)])
    bits = (2 * counts > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)``, one row per input row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint((x or "").encode(), shingle) for x in b["text"].to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(fps.view(np.int64))], ["id", "fp"])

    return spread(texts(docs, id_col, text_col)).mapInArrow(tidy(run), "id long, fp long")


class BKTree:
    """A BK-tree over distinct 64-bit values, searched by many queries at once.

    Nodes are numbered level by level, and on a level by parent and distance. ``edges`` holds for each node
    its parent's number times 65 plus its Hamming distance to the parent (the root: -1), in ascending
    order, so the children of a node within a range of distances are found by binary search.
    """

    def __init__(self, values: np.ndarray, edges: np.ndarray):
        self.values, self.edges = values, edges.astype(np.int64)

    @classmethod
    def grow(cls, values: np.ndarray) -> BKTree:
        """The tree that inserting the values one after the other makes, grown level by level."""
        rest, key = np.asarray(values, np.uint64), np.full(len(values), -1, np.int64)
        nodes, edges, count = [], [], 0
        while len(rest):
            first = np.r_[True, key[1:] != key[:-1]]
            parent = np.cumsum(first) - 1
            nodes.append(rest[first])
            edges.append(key[first])
            far = np.bitwise_count(rest ^ rest[first][parent]).astype(np.int64)
            key = ((count + parent) * 65 + far)[~first]
            count += len(nodes[-1])
            order = np.argsort(key, kind="stable")
            rest, key = rest[~first][order], key[order]
        return cls(np.concatenate([np.zeros(0, np.uint64), *nodes]), np.concatenate([np.zeros(0, np.int64), *edges]))

    def search(self, queries: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (number of a query, number of a node) within the radius."""
        queries = np.asarray(queries, np.uint64)
        step = max(16, (1 << 21) // max(1, len(self.values)))  # so that what is followed at once stays small
        for lo in range(0, len(queries) if len(self.values) else 0, step):
            asking = np.arange(lo, min(lo + step, len(queries)))
            at = np.zeros(len(asking), np.int64)
            while len(asking):
                far = np.bitwise_count(queries[asking] ^ self.values[at]).astype(np.int64)
                if (hit := far <= radius).any():
                    yield asking[hit], at[hit]
                first = np.searchsorted(self.edges, at * 65 + np.maximum(far - radius, 0), "left")
                n = np.searchsorted(self.edges, at * 65 + np.minimum(far + radius, 64), "right") - first
                asking = np.repeat(asking, n)
                at = np.arange(len(asking)) + np.repeat(first - (np.cumsum(n) - n), n)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Put a[k] and b[k] into one component each; label holds the least member of everyone's component."""
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tolist() != label.tolist():
            label[:] = up


def shard_stars(tree: BKTree, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (a, b) of the components that the queries make with the tree's values."""
    vertices, back = np.unique(np.concatenate([tree.values, queries]), return_inverse=True)
    label = np.arange(len(vertices))
    for q, node in tree.search(queries, radius):
        merge(label, back[len(tree.values) + q], back[node])
    own = np.flatnonzero(label != np.arange(len(vertices)))
    return vertices[own], vertices[label[own]]


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprints of each part of a shard to its stored tree."""
    for b in batches:
        trees = [BKTree.grow(np.sort(v.values.to_numpy().view(np.uint64))) for v in b["fps"]]
        yield pa.RecordBatch.from_arrays(
            [b["shard"], b["part"], b["parts"], pa.array([t.values.astype("<u8").tobytes() for t in trees], pa.binary()), pa.array([t.edges.astype("<i4").tobytes() for t in trees], pa.binary())],
            ["shard", "part", "parts", "nodes", "edges"],
        )


def _searched(radius: int):
    """Trees with the fingerprints to search for, to spanning edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for nodes, edges, asked in zip(*(b[c].to_pylist() for c in ("nodes", "edges", "asked")), strict=True):
                found = shard_stars(BKTree(np.frombuffer(nodes, "<u8"), np.frombuffer(edges, "<i4")), np.frombuffer(asked, "<u8"), radius)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], ["a", "b"])

    return run


def layout(n: int, radius: int, size: float = SHARD) -> list[list[tuple[int, int]]]:
    """For each table of shards the bit ranges (first bit, width) that make its key, for n fingerprints."""
    bits = max(0, ceil(n / size) - 1).bit_length()
    width = 64 // (radius + 1)
    if not bits:
        return [[]]
    if bits <= width:
        return [[(k * width, bits)] for k in range(radius + 1)]
    width = 64 // (radius + 2)
    return [[(i * width, width), (j * width, width)] for i, j in combinations(range(radius + 2), 2)]


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, size: float = SHARD) -> DataFrame:
    """Spanning edges ``(a, b)`` among the distinct values of ``fp`` that connect all within the radius."""
    fps = stored(fps.select("fp").distinct(), "distinct")
    tables = layout(n := fps.count(), radius, size)

    def key(t: int, ranges: list[tuple[int, int]]):
        out = F.lit(t).cast("long")
        for first, width in ranges:
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        return out

    dealt = fps.select("fp", F.explode(F.array(*(key(t, r) for t, r in enumerate(tables)))).alias("shard"))
    shards = dealt.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    cut = hot_join(dealt, shards, "shard", "n", n * len(tables)).select("shard", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"))
    groups = cut.groupBy("shard", "part", "parts").agg(F.collect_list("fp").alias("fps"))
    trees = stored(groups.mapInArrow(_grown, "shard long, part int, parts int, nodes binary, edges binary"), "trees")
    # tree i meets the fingerprints of tree j >= i
    index = trees.select("shard", F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("j"), "nodes", "edges")
    asked = trees.select("shard", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"), F.col("nodes").alias("asked"))
    return index.join(asked, ["shard", "i", "j"]).select("nodes", "edges", "asked").mapInArrow(tidy(_searched(radius)), "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """``(v, root)`` for each vertex of ``(a, b)`` edges, root the least value of its component.

    Alternating large-star and small-star rounds; each is written to the shared folder, so a lost
    executor costs one round at most. The number of rounds is logarithmic.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    count = edges.count()
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times")).select("u", F.least("u", "m").alias("m"), "times")
        large = hot_join(both, least, "u", "times", 2 * count).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = large.filter("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = stored(small.filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
        before, count = now, now[0]


def components(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``(id, fp, component_id)`` from ``(id, fp)``: the least id reachable over links."""
    fps = stored(fps, "fps")
    roots = connected(links(fps, radius, block))
    first = fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    placed = stored(first.join(roots, first.fp == roots.v, "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")), "placed")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("times"))
    n_fps, n_rows = placed.agg(F.count("*"), F.sum("rows")).first()
    by_fp = hot_join(placed, named, "root", "times", n_fps).select("fp", "component_id", "rows")
    return hot_join(fps, by_fp, "fp", "rows", n_rows or 0).select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row."""
    found = components(fingerprints(docs, id_col, text_col, shingle), radius, block)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def shingles(text: str, size: int = NEAR_SHINGLE) -> set[bytes]:
    """The word shingles of a text (of the whole text where it is shorter), of words as in :func:`fingerprint`."""
    words = text.encode().lower().split()
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def bands(grams: set[bytes]) -> tuple[np.ndarray, bytes]:
    """A key for each of ``BANDS`` bands of ``BAND_ROWS`` min-hashes, and the min-hashes' lowest bytes."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(7)), np.uint64, len(grams))
    least = np.full(len(_MULTIPLY), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        part = hashes[at : at + 512] * _MULTIPLY[:, None]
        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=1))
    rows = least[: BANDS * BAND_ROWS].astype("<u8").reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64), least.astype(np.uint8).tobytes()


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, fp, whole, bands, sketch): whole tells texts of equal words, bands is null without words."""
    for b in batches:
        got = b["text"].to_pylist()
        fps = np.fromiter((fingerprint((x or "").encode()) for x in got), np.uint64, b.num_rows)
        whole = np.fromiter((xxhash.xxh64_intdigest(b" ".join((x or "").encode().lower().split())) for x in got), np.uint64, b.num_rows)
        keys = [bands(g) if (g := shingles(x or "")) else (None, None) for x in got]
        yield pa.RecordBatch.from_arrays(
            [b["id"], pa.array(fps.view(np.int64)), pa.array(whole.view(np.int64)), pa.array([k[0] for k in keys], pa.list_(pa.int64())), pa.array([k[1] for k in keys], pa.binary())],
            ["id", "fp", "whole", "bands", "sketch"],
        )


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two parts of a key's rows to the pairs of different roots that share ``LIKELY`` of their min-hashes.

    A pair that shares several keys is put out for the first of them alone.
    """

    def columns(rows) -> list[np.ndarray]:
        sketch = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        return [rows.field(c).to_numpy() for c in ("id", "fp", "root")] + [sketch, rows.field("bands").flatten().to_numpy().reshape(-1, BANDS)]

    for b in batches:
        for key, left, right in zip(b["key"].to_pylist(), b["x"], b["y"], strict=True):
            (ids, fps, roots, sketch, keys), (ids2, fps2, roots2, sketch2, keys2) = columns(left.values), columns(right.values)
            same = np.array_equal(ids, ids2)  # a part with itself: each pair once
            for i in range(len(ids)):
                j = np.flatnonzero((roots2 != roots[i]) & (ids2 > ids[i] if same else True))
                j = j[(sketch2[j] == sketch[i]).mean(axis=1) >= LIKELY]
                first = (keys2[j] == keys[i]).argmax(axis=1)
                if (j := j[keys[i][first] == key]).size:
                    less = ids2[j] < ids[i]
                    pair = [np.where(less, ids2[j], ids[i]), np.where(less, ids[i], ids2[j]), np.where(less, fps2[j], fps[i]), np.where(less, fps[i], fps2[j])]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["a", "b", "fa", "fb"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose shingle sets have a Jaccard similarity of ``SIMILAR`` or more, as links of fingerprints."""
    for b in batches:
        last, left, keep = None, set(), []
        for a, x, y in zip(b["a"].to_pylist(), b["x"].to_pylist(), b["y"].to_pylist(), strict=True):
            if a != last:
                last, left = a, shingles(x)
            right = shingles(y)
            both = len(left & right)
            keep.append(both >= SIMILAR * (len(left) + len(right) - both))
        yield pa.RecordBatch.from_arrays([b["fa"], b["fb"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The links ``(a, b)`` of fingerprints of the pairs that are similar."""
    pairs = stored(pairs.distinct(), "pairs")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("__cl_row")).distinct(), "ids")
    text = chosen(rows, ids, "__cl_row").select(F.col("__cl_row").alias("a"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("x"))
    times = pairs.groupBy("a").agg(F.count("*").alias("times"))
    both = pairs.join(text.toDF("b", "y"), "b")
    met = hot_join(both, text.join(times, "a"), "a", "times", pairs.count()).select("a", "x", "y", "fa", "fb")
    return stored(met.mapInArrow(tidy(_similar), "a long, b long").distinct(), "similar")


def _apart(met: DataFrame, roots: DataFrame, sketches: DataFrame, group: int) -> DataFrame:
    """Pairs of one key that are likely similar and in different groups still, from ``met (key, id, fp)``."""
    placed = met.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = placed.groupBy("key").agg(F.count("*").alias("times"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key", "times")
    mixed = stored(mixed, "mixed")
    parts = F.ceil(F.col("times") / group).cast("int")
    cut = hot_join(placed, mixed, "key", "times", mixed.agg(F.sum("times")).first()[0] or 0).select("key", "id", "fp", "root", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    rows = cut.join(sketches, "id").groupBy("key", "part", "parts").agg(F.collect_list(F.struct("id", "fp", "root", "sketch", "bands")).alias("rows"))
    rows = stored(rows, "groups")
    # part i meets part j >= i, its own included
    left = rows.select("key", F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("j"), F.col("rows").alias("x"))
    right = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"), F.col("rows").alias("y"))
    return left.join(right, ["key", "i", "j"]).select("key", "x", "y").mapInArrow(tidy(_likely), "a long, b long, fa long, fb long")


def leaders(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """One document of each group, with its columns as they are: the one with the least id (null last), of equal ids the first row.

    Two texts are linked if their fingerprints are, or if their sets of 5-word shingles have a
    Jaccard similarity of 0.8 or more: candidates share a band of min-hashes (a pair of similarity
    0.8 has none with a chance of about 3 in a million), and their texts decide. First each text of a band's
    key meets the key's first one; then, in parts of about ``group`` rows, those that are in different groups still.
    """
    rows = keyed(docs)
    fps = stored(spread(texts(rows, "__cl_row", "text")).mapInArrow(tidy(_banded), "id long, fp long, whole long, bands array<long>, sketch binary"), "fps")
    one = fps.filter("bands is not null").join(fps.groupBy("whole").agg(F.min("id").alias("id")).select("id"), "id", "left_semi")
    keys = one.select(F.explode("bands").alias("key"), "id", "fp")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "fp")).alias("first")).filter("n > 1")
    met = stored(hot_join(keys, shared, "key", "n", BANDS * fps.count()).select("key", "id", "fp", "first"), "bands")
    star = met.filter(F.col("id") != F.col("first.id")).select(F.col("first.id").alias("a"), F.col("id").alias("b"), F.col("first.fp").alias("fa"), F.col("fp").alias("fb"))
    roots = connected(links(fps).union(_verified(star, rows)))
    more = _verified(_apart(met.drop("first"), roots, fps.select("id", "sketch", "bands"), group), rows)
    roots = connected(roots.toDF("a", "b").union(more))
    least = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.col("__cl_row").alias("row"))
    first = fps.join(rows.select("__cl_row", least.alias("least")), fps.id == F.col("__cl_row")).groupBy("fp").agg(F.min("least").alias("least"))
    placed = first.join(roots, first.fp == roots.v, "left").groupBy(F.coalesce("root", "fp")).agg(F.min("least").alias("least"))
    copies = fps.select(F.col("id").alias("__cl_row")).join(placed.select(F.col("least.row").alias("__cl_row")), "__cl_row", "left_anti")
    return chosen(rows, stored(copies, "copies"), "__cl_row", out=True).select(*docs.columns)
