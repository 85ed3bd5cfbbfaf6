"""Exact removal of byte strings that occur more than once, by enhanced suffix arrays.

Every string of ``min_bytes`` (200) bytes that starts at two places is found, in one text or in two.

1. *Anchors.* Of the 32-byte grams in each 200-byte window the one with the least hash (the
   leftmost of equals) is the window's anchor. It depends on the window's content alone, so equal
   windows have equal anchors. Windows whose anchor's hash occurs once in the corpus cannot repeat.
2. *Buckets.* Runs of windows with one repeated anchor go, with their bytes, to the anchor's bucket.
   Equal texts send their bytes once.
3. *Enhanced suffix array.* In a bucket the suffixes that share 200 bytes with another (met by a hash, told
   apart by their bytes) are sorted lexicographically up to ``CAP`` bytes. A stack scan over the common-prefix lengths
   of neighbours makes the interval tree. An interval is a repeat group with all its occurrences; it is
   put out if its left extensions differ, or its length has reached ``CAP`` (a longer repeat is
   the chain of such groups, one for each start; :func:`maximal_repeats` gives it in one). A group with one left
   extension lies within the group one byte to the left.
4. *Hot buckets* are cut into blocks of about ``BLOCK`` runs. Across blocks, one window per group
   and the windows without a partner are met by their hash, pre-aggregated before the shuffle; of
   those that meet, the bytes are read and decide.

The result does not depend on how buckets and blocks fall: the bytes marked are exactly those
covered by a repeated 200-byte string.

Nulls and empty texts have no bytes: nothing is removed. Texts shorter than ``min_bytes`` stay. Every row has a
key of its own from the scan: ids may be null or repeat, with equal or different texts, and each row gives one
output row and counts as an occurrence. Equal texts of ``min_bytes`` or more go entirely. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import chosen, hot_join, keyed, spread, stored, table, texts, tidy

MIN_BYTES = 200
#: Common prefixes are measured up to this length.
CAP = 256
GRAM = 32
#: Runs of one bucket that one task sorts together.
BLOCK = 4096
#: Window starts handled at once; longer texts are cut with an overlap.
PIECE = 1 << 19
#: Suffixes sorted at once.
CHUNK = 100_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _mixed(data: np.ndarray) -> np.ndarray:
    table = np.random.default_rng(1).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    return table[data]


def _doubled(h: np.ndarray, at: int) -> np.ndarray:
    """Hashes of the ``2 * at`` bytes from each place out of those of ``at`` bytes."""
    out = h[: max(0, len(h) - at)] * _ODD[at.bit_length() % 8]
    out ^= out >> np.uint64(29)
    out += h[at:]
    return out


def window_hash(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each window of ``width`` bytes."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    n = len(data) - width + 1
    part, bit, at, out = _mixed(data), 1, 0, None
    while bit <= width:
        if width & bit:
            own = part[at : at + n]
            out = own.copy() if out is None else (out * _ODD[7] ^ (out >> np.uint64(31))) + own
            at += bit
        if bit * 2 <= width:
            part = _doubled(part, bit)
        bit *= 2
    return out


def anchor_runs(data: np.ndarray, width: int = MIN_BYTES, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor hash) of the runs of windows with one anchor."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, at = _mixed(data), 1
    while at < gram:
        h, at = _doubled(h, at), at * 2
    h *= _ODD[5]
    h ^= h >> np.uint64(32)
    low = np.uint64((1 << 24) - 1)
    best = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span, at = width - gram + 1, 1
    while at * 2 <= span:
        best = np.minimum(best[:-at], best[at:])
        at *= 2
    best = np.minimum(best[:n], best[span - at : span - at + n])
    place = (best & low).astype(np.int64)
    first = np.r_[0, np.flatnonzero(np.diff(place)) + 1]
    return first, np.diff(np.r_[first, n]), h[place[first]]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs by text, and one row (key null) with the digest of each text."""
    for b in batches:
        ids, starts, counts, keys, digests, sizes = [], [], [], [], [], []

        def put() -> pa.RecordBatch:
            none = pa.array([None] * len(digests), pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(np.concatenate(ids) if ids else [], pa.int64()), pa.array(digest_ids, pa.int64())]),
                    pa.concat_arrays([pa.array(np.concatenate(starts) if starts else [], pa.int64()), none]),
                    pa.concat_arrays([pa.array(np.concatenate(counts).astype(np.int32) if counts else [], pa.int32()), none.cast(pa.int32())]),
                    pa.concat_arrays([pa.array(np.concatenate(keys).view(np.int64) if keys else [], pa.int64()), none]),
                    pa.concat_arrays([pa.nulls(sum(map(len, ids)), pa.binary()), pa.array(digests, pa.binary())]),
                    pa.concat_arrays([pa.nulls(sum(map(len, ids)), pa.int64()), pa.array(sizes, pa.int64())]),
                    pa.concat_arrays([pa.nulls(sum(map(len, ids)), pa.int64()), b["own"]]),
                ],
                ["id", "start", "n", "key", "digest", "n_bytes", "own"],
            )

        digest_ids: list[int] = []
        held, rows = [], []

        def flush() -> None:
            """One pass over the texts held; a window that crosses texts is dropped."""
            if not held:
                return
            flat = np.concatenate(held)
            lengths = np.array([len(x) for x in held])
            ends = np.cumsum(lengths)
            first, n, key = anchor_runs(flat)
            if len(first):
                # cut runs at the texts' ends and drop the windows that cross one
                last_ok = ends - MIN_BYTES
                cuts = np.unique(np.r_[first, np.maximum(last_ok + 1, 0), ends[:-1]])
                cuts = cuts[cuts < len(flat) - MIN_BYTES + 1]
                run = np.searchsorted(first, cuts, "right") - 1
                doc = np.searchsorted(ends, cuts, "right")
                size = np.diff(np.r_[cuts, len(flat) - MIN_BYTES + 1])
                ok = cuts <= last_ok[doc]
                ids.append(np.array([r[0] for r in rows])[doc[ok]])
                starts.append(cuts[ok] - (ends - lengths)[doc[ok]] + np.array([r[1] for r in rows])[doc[ok]])
                counts.append(size[ok])
                keys.append(key[run[ok]])
            held.clear()
            rows.clear()

        total = 0
        for k, text in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
            raw = (text or "").encode()
            digest_ids.append(k)
            digests.append(hashlib.sha256(raw).digest())
            sizes.append(len(raw))
            data = np.frombuffer(raw, np.uint8)
            if len(data) < MIN_BYTES:
                continue
            for at in range(0, len(data) - MIN_BYTES + 1, PIECE):
                piece = data[at : at + PIECE + MIN_BYTES - 1]
                if total + len(piece) > PIECE:
                    flush()
                    total = 0
                held.append(piece)
                rows.append((k, at))
                total += len(piece)
        flush()
        yield put()


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for a lighter shuffle."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["id"], pa.array([squeeze.compress((x or "").encode()) for x in b["text"].to_pylist()], pa.binary())], ["id", "z"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run with its bytes: from its first start to CAP bytes past its last."""
    names = ["key", "block", "cut", "id", "start", "n", "bytes"]
    for b in batches:
        out: list[list] = [[] for _ in names]
        size = 0
        for k, z, runs in zip(b["id"].to_pylist(), b["z"].to_pylist(), b["runs"].to_pylist(), strict=True):
            raw = zstandard.decompress(z)
            for r in runs:
                for c, v in zip(out, (r["key"], r["block"], r["cut"], k, r["start"], r["n"], part := raw[r["start"] : r["start"] + r["n"] - 1 + CAP]), strict=True):
                    c.append(v)
                size += len(part)
            if size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _CONTEXT_TYPES, strict=True)], names)
                out, size = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _CONTEXT_TYPES, strict=True)], names)


_CONTEXT_TYPES = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())


def interval_groups(lcp: np.ndarray, left: np.ndarray, floor: int, cap: int) -> list[tuple[int, int, int]]:
    """Stack scan: (first, past the last, length) of the intervals of a suffix array to put out.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i (lcp[0] counts as 0). ``left[i]`` is the
    byte before suffix i, or -1 where none is known, which differs from any other. An interval
    with a common prefix of ``floor`` or more is put out if its left bytes differ or its length is
    ``cap`` (at which all comparisons end).
    """
    n = len(lcp)
    # up to each place, how often neighbours' left bytes differ
    differs = np.zeros(n + 1, np.int64)
    if n > 1:
        differs[2:] = np.cumsum((left[1:] != left[:-1]) | (left[1:] < 0) | (left[:-1] < 0))
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (common prefix, first suffix)
    steps = lcp.tolist()
    for i in range(1, n + 1):
        now = steps[i] if i < n else 0
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            if length >= cap or differs[i] > differs[first + 1]:
                found.append((first, i, length))
        if now >= floor and (not stack or stack[-1][0] < now):
            stack.append((now, first))
    return found


def bucket_groups(texts_: list[bytes], starts: np.ndarray, bucket: np.ndarray, floor: int = MIN_BYTES, cap: int = CAP) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Enhanced suffix array of the runs of some buckets.

    ``starts`` is the number of suffixes of each run, ``bucket`` its bucket's number. Returns the
    sorted suffixes as places in the joined bytes, the groups (first, past the last, length) over
    that order, the class (equal bucket and ``floor``-byte prefix) of each sorted suffix, and its hash.
    """
    flat = np.frombuffer(b"".join(texts_) + bytes(cap), np.uint8)
    lengths = np.array([len(x) for x in texts_], np.int64)
    begin = np.cumsum(lengths) - lengths
    run = np.repeat(np.arange(len(texts_)), starts)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(starts) - starts, starts)
    place = begin[run] + nth
    avail = np.minimum(lengths[run] - nth, cap)
    prefix = window_hash(flat, floor)[place] ^ (bucket[run].astype(np.uint64) * _ODD[1])
    order = np.argsort(prefix, kind="stable")
    same = prefix[order][1:] == prefix[order][:-1]
    paired = np.r_[False, same] | np.r_[same, False]
    alone = order[~paired]
    order = order[paired]
    # classes of equal prefixes in lexicographic order: by 16 bytes, and by all where these are the same
    opens = np.r_[True, prefix[order][1:] != prefix[order][:-1]] if len(order) else np.zeros(0, bool)
    lead = order[opens]
    words = lambda n, at: np.lib.stride_tricks.sliding_window_view(flat, n)[place[at]].copy().view(">u8")
    owner, front = bucket[run[lead]], words(16, lead)
    rank = np.lexsort((front[:, 1], front[:, 0], owner))
    same = (owner[rank][1:] == owner[rank][:-1]) & (front[rank][1:] == front[rank][:-1]).all(axis=1)
    if same.any():
        tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        whole = words(floor - floor % 8, lead[rank[tied]])
        rank[tied] = rank[tied][np.lexsort((*whole.T[::-1], owner[rank[tied]]))]
    number = np.empty(len(rank), np.int64)
    number[rank] = np.arange(len(rank))
    sorted_class = number[np.cumsum(opens) - 1]
    tail_words = (cap - floor) // 8
    tail = np.lib.stride_tricks.sliding_window_view(flat, cap - floor)[place[order] + floor].copy()
    tail[np.arange(cap - floor)[None, :] >= (avail[order] - floor)[:, None]] = 0
    cols = tail.view(">u8").astype(np.uint64)
    order2 = np.lexsort([*(cols[:, k] for k in range(tail_words - 1, -1, -1)), sorted_class])
    order, tail = order[order2], tail[order2]
    p = prefix[order]
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        head = np.lib.stride_tricks.sliding_window_view(flat, floor)
        equal = p[1:] == p[:-1]
        for lo in range(0, len(equal), 16384):  # the hash proposes, the bytes decide
            hi = min(lo + 16384, len(equal))
            equal[lo:hi] &= (head[place[order[lo + 1 : hi + 1]]] == head[place[order[lo:hi]]]).all(axis=1)
        unlike = tail[1:] != tail[:-1]
        more = np.where(unlike.any(axis=1), unlike.argmax(axis=1), cap - floor)
        lcp[1:] = np.where(equal, np.minimum(floor + more, np.minimum(avail[order][1:], avail[order][:-1])), 0)
    left = np.where(nth[order] > 0, flat[np.maximum(place[order] - 1, 0)].astype(np.int64), -1)
    cls = np.cumsum(lcp < floor)
    groups = interval_groups(lcp, left, floor, cap)
    return np.r_[place[order], place[alone]], groups, np.r_[cls, -np.ones(len(alone), np.int64)], np.r_[p, prefix[alone]]


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted bucket rows to removed spans (key null), and, of cut buckets, windows to meet across blocks."""
    names = ["id", "start", "n", "key", "hash", "found"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
    rows: list[tuple] = []
    suffixes = 0

    def work() -> Iterator[pa.RecordBatch]:
        nonlocal suffixes
        if not rows:
            return
        head = [(r[0], r[1]) for r in rows]
        bucket = np.cumsum([0, *(a != b for a, b in zip(head[1:], head[:-1], strict=True))])
        several = np.bincount(bucket)[bucket] > 1
        own = [i for i, r in enumerate(rows) if several[i] or r[2] or r[5] > 1]
        if own:
            # runs of equal bytes stand in the suffix array once: all their windows are repeats
            number: dict[tuple, int] = {}
            same = np.array([number.setdefault((bucket[i], rows[i][5], rows[i][6]), len(number)) for i in own])
            times = np.bincount(same)
            members = np.argsort(same, kind="stable")
            member = np.cumsum(times) - times  # place of each one's first member
            everyone, own = own, [own[i] for i in members[member]]
            used = [rows[i] for i in own]
            lengths = np.array([len(r[6]) for r in used], np.int64)
            begin = np.cumsum(lengths) - lengths
            starts = np.array([r[5] for r in used])
            place, groups, cls, hashes = bucket_groups([r[6] for r in used], starts, bucket[own])
            marks = np.zeros(int(lengths.sum()) + 1, np.int32)
            np.add.at(marks, begin[times > 1], 1)
            np.add.at(marks, (begin + starts - 1 + MIN_BYTES)[times > 1], -1)
            if groups:
                g = np.array(groups)
                size = g[:, 1] - g[:, 0]
                at = place[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(g[:, 0], size)]
                np.add.at(marks, at, 1)
                np.add.at(marks, at + np.repeat(g[:, 2], size), -1)
            on = (np.cumsum(marks) > 0)[:-1].astype(np.int8)
            # runs of marked bytes, cut at the rows' ends
            change = np.zeros(len(on) + 1, bool)
            change[1:-1] = on[1:] != on[:-1]
            change[begin] = True
            change[-1] = True
            edge = np.flatnonzero(change)
            lo, hi = edge[:-1], edge[1:]
            keep = on[lo] > 0
            lo, hi = lo[keep], hi[keep]
            r = np.searchsorted(begin, lo, "right") - 1
            # the spans of each run that has these bytes
            each = np.repeat(np.arange(len(r)), times[r])
            who = members[member[r][each] + np.arange(len(each)) - np.repeat(np.cumsum(times[r]) - times[r], times[r])]
            all_ids, all_first = (np.array([rows[i][k] for i in everyone], np.int64) for k in (3, 4))
            none = pa.nulls(len(each), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(all_ids[who]), pa.array(all_first[who] + (lo - begin[r])[each]), pa.array((hi - lo).astype(np.int32)[each]), none, none, pa.nulls(len(each), pa.bool_())], names)
            ids = np.array([u[3] for u in used], np.int64)
            first = np.array([u[4] for u in used], np.int64)
            cut = np.array([u[2] for u in used])
            if cut.any():
                r = np.searchsorted(begin, place, "right") - 1
                _, lead = np.unique(cls, return_index=True)
                one = cls < 0
                one[lead] = True
                take = np.flatnonzero(one & cut[r])
                keys = np.array([u[0] for u in used], np.int64)
                for c in range(0, len(take), 500_000):
                    t = take[c : c + 500_000]
                    # the bucket's number is taken out again: blocks of one bucket must agree
                    plain = hashes[t] ^ (bucket[own][r[t]].astype(np.uint64) * _ODD[1])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r[t]]), pa.array((first[r] + place - begin[r])[t]), pa.nulls(len(t), pa.int32()), pa.array(keys[r[t]]), pa.array(plain.view(np.int64)), pa.array((cls[t] >= 0) | (times[r[t]] > 1))], names)
        rows.clear()
        suffixes = 0

    last = None
    for b in batches:
        for row in zip(*(b[c].to_pylist() for c in ("key", "block", "cut", "id", "start", "n", "bytes")), strict=True):
            if row[:2] != last and suffixes > CHUNK:
                yield from work()
            last = row[:2]
            rows.append(row)
            suffixes += row[5]
    yield from work()
    yield pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts' digests, compressed texts with repeats, removed spans by text).

    digests: ``id, own, digest, n_bytes, copies`` (id: the row's key, own: its id, copies: rows with the
    same text). kept: ``id, z`` of the texts that hold a repeated anchor and have no copies. found: ``id, start, n``.
    """
    # a key for each row; both readings take the same columns, so that they agree
    source = spread(texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("id"), F.col("id").alias("own"), "text"))
    scanned = stored(source.mapInArrow(tidy(_anchors), "id long, start long, n int, key long, digest binary, n_bytes long, own long"), "anchors")
    each = scanned.filter("digest is not null").select("id", "own", "digest", "n_bytes")
    alike = each.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("leader"))
    digests = stored(hot_join(each, alike, "digest", "copies", each.count()).select("id", "own", "digest", "n_bytes", "copies", (F.col("id") == F.col("leader")).alias("leads")), "digests")
    runs = scanned.filter("key is not null").select("id", (F.shiftleft("start", 8) + F.col("n")).alias("run"), "key")
    twice = runs.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1")
    k = F.ceil(F.col("times") / block).cast("int")
    hit = hot_join(runs, twice, "key", "times", runs.count()).select("id", F.struct(F.shiftright("run", 8).alias("start"), F.col("run").bitwiseAND(255).cast("int").alias("n"), "key", F.pmod(F.xxhash64("id"), k).cast("int").alias("block"), (k > 1).alias("cut")).alias("run"))
    by_text = hit.groupBy("id").agg(F.collect_list("run").alias("runs"))
    lead = digests.filter("leads").select("id", "copies")
    held = source.mapInArrow(tidy(_squeezed), "id long, z binary").join(by_text.join(lead, "id"), "id")
    held = stored(held, "held")
    context = held.select("id", "z", "runs").mapInArrow(tidy(_contexts), "key long, block int, cut boolean, id long, start long, n int, bytes binary")
    dealt = context.repartition("key", "block").sortWithinPartitions("key", "block")
    marked = stored(dealt.mapInArrow(tidy(_repeats), "id long, start long, n int, key long, hash long, found boolean"), "marked")
    within = marked.filter("key is null").select("id", "start", "n")
    windows = marked.filter("key is not null")
    met = windows.groupBy("key", "hash").agg(F.count("*").alias("times"), F.bool_and("found").alias("done")).filter("times > 1 and not done")
    asked = windows.join(met, ["key", "hash"], "left_semi").groupBy("id").agg(F.collect_list(F.struct("start", "key", "found")).alias("asked"))
    shown = stored(held.select("id", "z").join(asked, "id").mapInArrow(_shown, "id long, start long, key long, found boolean, bytes binary"), "shown")
    same = shown.groupBy("key", "bytes").agg(F.count("*").alias("times")).filter("times > 1")
    across = shown.filter("not found").join(same, ["key", "bytes"], "left_semi").select("id", "start", F.lit(MIN_BYTES).alias("n"))
    return digests, held.filter("copies = 1").select("id", "z"), within.union(across)


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with their bytes."""
    names, kinds = ["id", "start", "key", "found", "bytes"], (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    for b in batches:
        out: list[list] = [[] for _ in names]
        for k, z, asked in zip(b["id"].to_pylist(), b["z"].to_pylist(), b["asked"].to_pylist(), strict=True):
            raw = zstandard.decompress(z)
            for w in asked:
                for c, v in zip(out, (k, w["start"], w["key"], w["found"], raw[w["start"] : w["start"] + MIN_BYTES]), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the union of their spans: (id, n_bytes, n_removed, n_spans, rest, text); text is rest without the characters of which a part is gone."""
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for k, z, cuts in zip(b["id"].to_pylist(), b["z"].to_pylist(), b["cuts"].to_pylist(), strict=True):
            raw = zstandard.decompress(z)
            parts, at, removed, count, end = [], 0, 0, 0, -1
            for start, n in sorted((c["start"], c["n"]) for c in cuts or ()):
                if start > end:
                    count += 1
                    parts.append(raw[at:start])
                    end = start
                removed += max(0, start + n - end)
                end = at = max(end, start + n)
            parts.append(raw[at:])
            for c, v in zip(out, (k, len(raw), removed, count, b"".join(parts)), strict=True):
                c.append(v)
        out.append([x.decode("utf-8", "ignore") for x in out[-1]])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "rest", "text"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, rest binary or null, text, digest)`` by text.

    ``rest`` is null where the text is as it was or is gone entirely (n_removed says which).
    """
    digests, kept, found = spans(docs, id_col, text_col, block)
    cuts = found.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("cuts"))
    changed = kept.join(cuts, "id").mapInArrow(tidy(_cut_out), "id long, n_bytes long, n_removed long, n_spans long, rest binary, text string").drop("n_bytes")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= MIN_BYTES)
    return digests.join(changed, "id", "left").select(
        F.col("own").alias("id"), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        "rest", "text", "digest",
    )


def maximal_repeats(texts_: list[bytes], floor: int = MIN_BYTES) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Maximal repeats of a few texts, each with all its occurrences (text number, start).

    One suffix array over whole texts (no cap but the longest text): for texts that fit in memory.
    """
    longest = max([floor, *map(len, texts_)])
    cap = floor + -(-(longest - floor + 1) // 8) * 8
    used = [(i, t) for i, t in enumerate(texts_) if len(t) >= floor]
    if not used:
        return []
    lengths = np.array([len(t) for _, t in used])
    begin = np.cumsum(lengths) - lengths
    place, groups, _, _ = bucket_groups([t for _, t in used], lengths - floor + 1, np.zeros(len(used), np.int64), floor, cap)
    out = []
    for lo, hi, n in groups:
        r = np.searchsorted(begin, place[lo:hi], "right") - 1
        spots = sorted((used[k][0], int(p - begin[k])) for k, p in zip(r, place[lo:hi], strict=True))
        out.append((texts_[spots[0][0]][spots[0][1] : spots[0][1] + n], spots))
    return sorted(out, key=lambda x: x[1])


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(table(spark, sf_dir, "documents"))
    gone = F.sha2(F.lit(b""), 256)
    kept = F.when(F.col("n_removed") == 0, F.lower(F.hex("digest"))).when(F.col("rest").isNull(), gone).otherwise(F.sha2("rest", 256))
    return done.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", kept.alias("kept_sha256"))


def cut(docs: DataFrame) -> DataFrame:
    """The documents without repeats, with their columns; ``n_chars`` follows where it is there.

    A character of which only a part is repeated goes with the repeat. Ids may be null or repeat.
    """
    columns = docs.columns
    docs = keyed(docs)
    done = without_repeats(docs, "__cl_row").filter("n_removed > 0")
    changed = stored(done.select(F.col("id").alias("__cl_row"), F.coalesce("text", F.lit("")).alias("__cl_text")), "changed")
    # only the rows that change are shuffled, and without their old texts
    new = chosen(docs, changed, "__cl_row").drop("text").join(changed, "__cl_row").withColumn("text", F.col("__cl_text"))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return chosen(docs, changed, "__cl_row", out=True).select(*columns).union(new.select(*columns))
