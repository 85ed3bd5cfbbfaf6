"""Vector best-fit packing of token sequences.

A text's ids and a closing id 0 are cut, if longer than the token capacity, into full pieces and a
rest. Pieces go to bins under three capacities: tokens, documents and attention cost (the sum of
squared lengths). Among the bins with room in every dimension the one with the least weighted norm
of what would remain is chosen (``norm``), or the one with the greatest weighted dot product of
piece and residual (``dot``); if none has room a new bin opens. Pieces come longest first. They are
dealt to groups of about ``GROUP`` capacities, by their number among the stored pieces; a group is packed as a stream in sorted
order, with one entry held for each open bin. Groups, not tasks, decide the result: it is the same over any
number of partitions, and the last bins of a group, which may stay open, are few beside its others.

Nulls and empty texts are the closing id alone. Repeated rows are packed each. Ties between bins go to
the earlier bin, between pieces to the smaller id and piece. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import filterfalse, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.llm.common import spread, stored, table, texts, tidy

CAPACITY = 2048
#: Never reached by 2048 tokens, so that only tokens bind unless a caller lowers them.
DOCUMENTS = 2048
ATTENTION = 2048 * 2048
WEIGHTS = (1.0, 0.01, 0.01)
#: Sequences of one group of pieces.
GROUP = 2048
#: Bytes of either half of a tokenizer's word cache (words, ids and what an entry takes besides). When the young half is
#: full it becomes the old one, whose words are taken over as they are met again.
CACHE = 32 << 20
ENTRY = 200
#: Words that stay from one task to the next; the common ones are met first.
KEPT = 60_000
#: Longer words are not kept.
LONG_WORD = 256
#: White space of the tokenizer (Unicode White_Space), and what str.split() would split at besides.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ODD = "\x1c\x1d\x1e\x1f"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of whole texts by a word-level BPE file, with words kept in a bounded cache.

    The vocabulary's words never cross white space, so a text's ids are those of its words in turn.
    Texts with special tokens, or characters on which this shortcut and the library may differ,
    go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
        vocabulary = self.own.get_vocab()
        #: Whether an id ends a word.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        #: Ids of words and of their parts, in use lately and before; a part that is itself a word has the same ids as one.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        """Empty the cache but for the words met first, so that an idle worker does not hold it."""
        first = dict(islice((self.old or self.young).items(), KEPT))
        self.young, self.old, self.held = first, {}, ENTRY * len(first) + sum(map(len, first)) + sum(map(len, first.values()))

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part: many are encoded as one text, which falls at the ids that end a word."""
        out: list[bytes] = []
        for lo in range(0, len(parts), 10_000):
            some = parts[lo : lo + 10_000]
            ids = np.asarray(self.own.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) == len(some):
                raw = ids.tobytes()
                out += [raw[x:y] for x, y in zip([0, *ends], ends, strict=False)]
            else:
                out += [np.asarray(e.ids, "<u4").tobytes() for e in self.own.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.held > CACHE:
            self.young, self.old, self.held = {}, self.young, 0
        young, old = self.young, self.old
        out: list = [None] * len(batch)
        plain, rows = [], []
        for i, text in enumerate(batch):
            odd = not text.isascii() and any(unicodedata.category(c) == "Cn" or c in "Σİ" for c in set(text))
            if odd or any(s in text for s in self.special) or any(c in text for c in _ODD):
                out[i] = np.asarray(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                plain.append((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
                rows.append(i)
        # words as numbers: the batch's distinct ones alone become Python strings
        split = pc.utf8_split_whitespace(pa.array(plain, pa.string()))
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = {w: old[w] for w in filter(old.__contains__, filterfalse(young.__contains__, words))}
        young.update(found)
        missing = list(filterfalse(young.__contains__, words))
        # letters alone are one part
        parts = {w: self.split.findall(w) for w in missing if not w.isalpha()}
        new = list({p for some in parts.values() for p in some if p not in young} | {w for w in missing if w not in parts})
        found.update(zip(new, self._parts(new), strict=True))
        young.update(found)
        for w, some in parts.items():
            found[w] = young[w] = b"".join([young[p] for p in some])
        known = [young[w] for w in words]
        # ids of all words in turn, gathered out of those of the distinct ones
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat, start = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size
        each = size[codes]
        end = np.cumsum(each)
        ids = flat[np.arange(each.sum()) + np.repeat(start[codes] - (end - each), each)]
        cuts = np.r_[0, end][split.offsets.to_numpy()]
        for i, lo, hi in zip(rows, cuts[:-1], cuts[1:], strict=True):
            out[i] = ids[lo:hi].tobytes()
        self.held += ENTRY * len(found) + sum(map(len, found)) + sum(map(len, found.values()))
        for w in [w for w in found if len(w) > LONG_WORD]:
            self.held -= ENTRY + len(w) + len(young.pop(w))
        return out


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every whole text."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        for b in batches:
            owner, nth, start, length, crc = [], [], [], [], []
            for k, ids in zip(b["id"].to_pylist(), tokenizer.encode([x or "" for x in b["text"].to_pylist()]), strict=True):
                ids += b"\0\0\0\0"
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    owner.append(k)
                    nth.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        tokenizer.forget()

    return spread(texts(docs, id_col, text_col)).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Bins:
    """Open bins by residual tokens, then by residual documents and attention cost."""

    capacity: int = CAPACITY
    documents: int = DOCUMENTS
    attention: int = ATTENTION
    weights: tuple[float, float, float] = WEIGHTS
    by: str = "norm"
    opened: int = 0
    room: dict = field(default_factory=dict)
    mask: int = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        cost = length * length
        if length > self.capacity or cost > self.attention or self.documents < 1:
            raise ValueError(f"a piece of {length} tokens fits no bin")
        best, choice = None, None
        wt, wd, wa = self.weights
        left = self.mask >> length
        r = length - 1
        while left:
            step = (left & -left).bit_length()
            r += step
            left >>= step
            spare = wt * ((r - length) / self.capacity) ** 2
            if self.by == "norm" and best is not None and spare >= best[0]:
                break  # more tokens left over than any gain in the other dimensions
            for (docs, att), bins in self.room[r].items():
                if docs < 1 or att < cost:
                    continue
                if self.by == "norm":
                    score = spare + wd * ((docs - 1) / self.documents) ** 2 + wa * ((att - cost) / self.attention) ** 2
                else:
                    score = -(wt * length * r / self.capacity**2 + wd * docs / self.documents**2 + wa * cost * att / self.attention**2)
                if best is None or (score, bins[-1]) < best:
                    best, choice = (score, bins[-1]), (r, docs, att)
        if choice is None:
            number, r, docs, att = self.opened, self.capacity, self.documents, self.attention
            self.opened += 1
        else:
            r, docs, att = choice
            bins = self.room[r][docs, att]
            number = bins.pop()
            if not bins:
                del self.room[r][docs, att]
                if not self.room[r]:
                    del self.room[r]
                    self.mask ^= 1 << r
        if r > length and docs > 1 and att > cost:
            self.room.setdefault(r - length, {}).setdefault((docs - 1, att - cost), []).append(number)
            self.mask |= 1 << (r - length)
        return number, self.capacity - r


def pack(items: DataFrame, capacity: int = CAPACITY, documents: int = DOCUMENTS, attention: int = ATTENTION, weights: tuple[float, float, float] = WEIGHTS, by: str = "norm") -> DataFrame:
    """Rows with ``length`` (1 to capacity) and ``doc_id, piece``, with ``sequence_id`` and ``offset``."""
    items = stored(items, "pieces")
    total = items.agg(F.sum("length")).first()[0] or 0
    groups = -(-total // (GROUP * capacity)) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bins = None, None
        for b in batches:
            numbers, offsets = [], []
            for g, n in zip(b["__cl_group"].to_pylist(), b["length"].to_pylist(), strict=True):
                if g != last:
                    last, bins = g, Bins(capacity, documents, attention, weights, by)
                number, offset = bins.place(n)
                numbers.append((g << 32) + number)
                offsets.append(offset)
            plain = b.drop_columns(["__cl_group"])
            yield pa.RecordBatch.from_arrays([*plain.columns, pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())], [*plain.schema.names, "sequence_id", "offset"])

    schema = StructType([*items.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    # by the row's number, so that rows that repeat are not dealt to one group
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    dealt = items.withColumn("__cl_group", group).repartition(groups, "__cl_group").sortWithinPartitions("__cl_group", F.desc("length"), "doc_id", "piece")
    return dealt.mapInArrow(run, schema)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
