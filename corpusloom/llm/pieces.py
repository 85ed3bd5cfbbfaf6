"""SentencePiece encoding and decoding as a relational lattice.

Encoding: a text gets a leading space, spaces become U+2581, and it falls into words (a run of U+2581
and what follows up to the next). Distinct words are exploded into their substrings of bounded length,
equi-joined to the piece table (its size is the model's, so it is broadcast), and the edges grouped by
word: words are dealt by their key before they are exploded, so the lattice itself is not shuffled. A
higher-order aggregate folds a word's edges from left to right, keeping the best score of each place
(Viterbi), and another follows the best edges back. The first holds the scores of the places a piece can reach
back to, and both add to blocks of ``BLOCK``, so a long word costs time in proportion to its edges. A
character without a piece takes its UTF-8 byte pieces at ``unknown`` score. The texts' words then look their
ids up by an equi-join, and each text's ids are put in order.

``viterbi``, the method, finds the pieces of the greatest total score, of equal totals those that the leftmost longer
edges make. For a model trained by merges (BPE) the library merges pairs by score instead, which gives other
ids for some words; ``mode="bpe"`` does this with a heap for each word, in Arrow batches.

Decoding: ids become their pieces' bytes, U+2581 a space, and the leading space is taken away.

Null and empty texts have no ids. A literal U+2581 decodes to a space, as in the library. Repeated
rows get one output row each. An empty table gives an empty result. Columns ``ids`` and ``score`` of the input are
replaced; other columns are kept, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import spread, stored, table

MARK = "▁"
#: Characters of a word exploded together, and entries of one block of a fold's state.
CHUNK = 256
BLOCK = 64


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(piece, piece_id int, score double, kind, bytes binary)`` of a model file; kind is normal or byte."""
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=path or model_path())
    rows = []
    for i in range(own.get_piece_size()):
        name = own.id_to_piece(i)
        if own.is_byte(i):
            rows.append((name, i, own.get_score(i), "byte", bytes([int(name[3:5], 16)])))
        elif not own.is_control(i) and not own.is_unknown(i) and not own.is_unused(i):
            rows.append((name, i, own.get_score(i), "normal", name.replace(MARK, " ").encode()))
    return spark.createDataFrame(rows, "piece string, piece_id int, score double, kind string, bytes binary")


def _words(text: Column) -> Column:
    marked = F.concat(F.lit(MARK), F.translate(text, " ", MARK))
    return F.when(F.length(text) > 0, F.regexp_extract_all(marked, F.lit(f"({MARK}+[^{MARK}]*)"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def lattice(words: DataFrame, pieces: DataFrame) -> tuple[DataFrame, int]:
    """``(word_id, edges array<struct<end, start, piece_id, score, char>>)`` by end and start, and the longest piece's length.

    ``words`` is ``(word_id, word)``, distinct; ``char`` is null but for characters without a piece.
    """
    normal = pieces.filter("kind = 'normal'").select("piece", "piece_id", "score")
    got = normal.agg(F.max(F.length("piece")).alias("m"), F.min("score").alias("s")).first()
    most, unknown = int(got["m"] or 1), float(got["s"] or 0.0) - 10
    chunks = words.repartition("word_id").select("word_id", "word", F.length("word").alias("size"), F.explode(F.sequence(F.lit(0), F.floor((F.length("word") - 1) / CHUNK).cast("int"))).alias("c"))
    base = F.col("c") * CHUNK
    chunks = chunks.select("word_id", base.alias("base"), (F.col("size") - base).alias("left"), F.substring("word", base + 1, F.lit(CHUNK + most - 1)).alias("part"))
    at = chunks.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(CHUNK), "left") - 1)).alias("i"))
    cut = at.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("left") - F.col("i")))).alias("n"))
    cut = cut.select("word_id", (F.col("base") + F.col("i")).alias("start"), "n", F.substring("part", F.col("i") + 1, F.col("n")).alias("piece"))
    met = cut.join(F.broadcast(normal), "piece", "left").filter("piece_id is not null or n = 1")
    edge = F.struct(
        (F.col("start") + F.col("n")).alias("end"), "start", F.coalesce("piece_id", F.lit(-1)).alias("piece_id"), F.coalesce("score", F.lit(unknown)).alias("score"),
        F.when(F.col("piece_id").isNull(), F.col("piece")).alias("char"),
    )
    return met.select("word_id", edge.alias("edge")).groupBy("word_id").agg(F.sort_array(F.collect_list("edge")).alias("edges")), most


_BEST = "struct<start:int,piece_id:int,char:string>"


def _added(done: Column, current: Column, item: Column) -> list[Column]:
    """``done`` and ``current`` after an item more: full blocks go to ``done``, so an item costs a block's length at most."""
    full = F.size(current) >= BLOCK
    return [F.when(full, F.concat(done, F.array(current))).otherwise(done).alias("done"), F.when(full, F.array(item)).otherwise(F.concat(current, F.array(item))).alias("current")]


def _fold(edges: Column, most: int) -> Column:
    """Best last edge of each place, ``best array<struct<start, piece_id, char>>``, and the whole word's ``score``.

    A step is one edge, and edges come by end, then start, so a place is done before any edge leaves it.
    ``window`` holds the best totals of the last places, up to the place reached.
    """
    zero = F.struct(
        F.lit(0).alias("place"), F.array(F.lit(0.0)).alias("window"),
        F.array().cast(f"array<array<{_BEST}>>").alias("done"), F.array().cast(f"array<{_BEST}>").alias("current"),
    )

    def step(s: Column, e: Column) -> Column:
        last = F.size(s["window"]) - 1
        total = F.get(s["window"], last - (s["place"] - e["start"])) + e["score"]
        mine = F.struct(e["start"].alias("start"), e["piece_id"].alias("piece_id"), e["char"].alias("char"))
        totals = F.concat(s["window"], F.array(total))
        on = F.struct(e["end"].alias("place"), F.when(last >= most, F.slice(totals, F.lit(2), F.lit(most + 1))).otherwise(totals).alias("window"), *_added(s["done"], s["current"], mine))
        swap = lambda x, y: F.concat(F.slice(x, F.lit(1), F.size(x) - 1), F.array(y))
        better = F.struct(s["place"].alias("place"), swap(s["window"], total).alias("window"), s["done"].alias("done"), swap(s["current"], mine).alias("current"))
        return F.when(e["end"] > s["place"], on).when(total > F.get(s["window"], last), better).otherwise(s)

    return F.aggregate(edges, zero, step, lambda s: F.struct(F.flatten(F.concat(s["done"], F.array(s["current"]))).alias("best"), F.element_at(s["window"], -1).alias("score")))


def _path(best: Column) -> Column:
    """Best edges followed back from the end: array of (start, piece_id, char) in order."""
    zero = F.struct(F.size(best).alias("at"), F.array().cast(f"array<array<{_BEST}>>").alias("done"), F.array().cast(f"array<{_BEST}>").alias("current"))

    def step(s: Column, place: Column) -> Column:
        mine = F.get(best, place - 1)
        return F.when(s["at"] == place, F.struct(mine["start"].alias("at"), *_added(s["done"], s["current"], mine))).otherwise(s)

    return F.aggregate(F.sequence(F.size(best), F.lit(1)), zero, step, lambda s: F.reverse(F.flatten(F.concat(s["done"], F.array(s["current"])))))


def _viterbi(words: DataFrame, pieces: DataFrame, first: int) -> DataFrame:
    edges, most = lattice(words, pieces)
    folded = edges.select("word_id", _fold(F.col("edges"), most).alias("f"))
    ways = folded.select("word_id", F.col("f.score").alias("score"), _path(F.col("f.best")).alias("way"))

    def ids(w: Column) -> Column:
        raw = F.hex(F.encode(w["char"], "UTF-8"))
        spelled = F.transform(F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1), lambda k: F.conv(F.substring(raw, 2 * k + 1, F.lit(2)), 16, 10).cast("int") + F.lit(first))
        return F.when(w["piece_id"] >= 0, F.array(w["piece_id"])).otherwise(spelled)

    return ways.select("word_id", F.flatten(F.transform("way", ids)).alias("ids"), "score")


def merged(word: str, pieces: dict[str, tuple[int, float]]) -> list[str]:
    """The pieces of a word after merging, again and again, the two neighbours whose piece has the best score (ties: the leftmost)."""
    text, left, right = list(word), list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < len(text) and (found := pieces.get(text[i] + text[j])):
            heapq.heappush(heap, (-found[1], i, j, text[i] + text[j]))

    for i in range(len(text) - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, piece = heapq.heappop(heap)
        if not text[i] or not text[j] or right[i] != j or text[i] + text[j] != piece:
            continue  # one of the two was merged since
        text[i], text[j], right[i] = piece, "", right[j]
        if right[j] < len(text):
            left[right[j]] = i
        offer(left[i], i)
        offer(i, right[i])
    return [x for x in text if x]


def _bpe(words: DataFrame, pieces: DataFrame, first: int) -> DataFrame:
    known = {r["piece"]: (r["piece_id"], r["score"]) for r in pieces.filter("kind = 'normal'").select("piece", "piece_id", "score").collect()}  # the model's size
    unknown = min((s for _, s in known.values()), default=0.0) - 10
    sent = words.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            ids, scores = [], []
            for word in b["word"].to_pylist():
                parts = merged(word, table)
                ids.append([i for x in parts for i in ([table[x][0]] if x in table else [first + c for c in x.encode()])])
                scores.append(sum(table[x][1] if x in table else unknown for x in parts))
            yield pa.RecordBatch.from_arrays([b["word_id"], pa.array(ids, pa.list_(pa.int32())), pa.array(scores, pa.float64())], ["word_id", "ids", "score"])

    return words.select("word_id", "word").mapInArrow(run, "word_id long, ids array<int>, score double")


def vocabulary(words: DataFrame, pieces: DataFrame, mode: str = "viterbi") -> DataFrame:
    """``(word, ids array<int>, score double)`` of distinct words."""
    if mode not in ("viterbi", "bpe"):
        raise ValueError(f"no mode {mode}")
    first = pieces.filter("kind = 'byte'").agg(F.min("piece_id")).first()[0]
    words = stored(words.select("word").withColumn("word_id", F.monotonically_increasing_id()), "words")
    return words.join((_viterbi if mode == "viterbi" else _bpe)(words, pieces, first or 0), "word_id").select("word", "ids", "score")


def encode(rows: DataFrame, text_col: str, pieces: DataFrame, mode: str = "viterbi") -> DataFrame:
    """The rows with a key ``__cl_row`` and with ``ids array<int>`` and ``score double``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = stored(spread(rows.withColumn("__cl_text", text).drop("ids", "score")).withColumn("__cl_row", F.monotonically_increasing_id()), "texts")
    split = kept.select("__cl_row", _words(F.col("__cl_text")).alias("w"))
    known = stored(vocabulary(split.select(F.explode("w").alias("word")).distinct(), pieces, mode), "vocabulary")
    met = split.select("__cl_row", F.posexplode("w").alias("at", "word")).join(known, "word")
    got = met.groupBy("__cl_row").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("x"), F.sum("score").alias("score"))
    got = got.select("__cl_row", F.flatten("x.ids").alias("ids"), "score")
    out = kept.drop("__cl_text").join(got, "__cl_row", "left")
    return out.withColumns({"ids": F.coalesce("ids", F.array().cast("array<int>")), "score": F.coalesce("score", F.lit(0.0))})


def decode(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """The rows with ``decoded string`` of their ``ids``; unknown and null ids are skipped, null ids arrays give an empty text.

    The pieces' bytes, as many as the model has, are one constant array by id; no row is shuffled.
    """
    known = {r["piece_id"]: r["h"] for r in pieces.select("piece_id", F.hex("bytes").alias("h")).collect()}  # the model's size
    by_id = F.split(F.lit(",".join(known.get(i) or "" for i in range(max(known, default=0) + 1))), ",")
    spelled = F.transform("ids", lambda i: F.coalesce(F.get(by_id, i), F.lit("")))
    whole = F.decode(F.unhex(F.array_join(F.coalesce(spelled, F.array().cast("array<string>")), "")), "UTF-8")
    return rows.withColumn("decoded", F.when(whole.startswith(" "), F.substring(whole, 2, 1 << 30)).otherwise(whole))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = piece_table(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    back = decode(encode(rows, "text", pieces), pieces)
    text = F.coalesce("text", F.lit(""))
    return back.select("conv_id", "turn", F.size("ids").cast("long").alias("n_tokens"), "score", F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"), (F.col("decoded") == text).alias("restored"))
