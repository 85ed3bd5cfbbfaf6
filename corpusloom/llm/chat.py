"""Chat formatting by columnar byte assembly.

A conversation's turns (in order of turn, then role, then text) become ``<s>`` and one stretch per turn:
``[INST] text [/INST]`` for users, ``text</s>`` for assistants, ``<<SYS>>text<</SYS>>`` for systems and
``[ROLE=name]text[/ROLE]`` for any other role (percent-coded). In texts a control string gets one
more backslash after its first character (``<\\/s>``), which reading back takes away; so any text is
restored exactly. The loss mask covers assistant texts.

A batch is laid out in numpy: the lengths of headers, contents and closings give cumulative offsets
and scatter indices, and all bytes are copied into one preallocated Arrow buffer. Rows come sorted
from one shuffle by conversation; a conversation is put out in parts as it streams by, so one with a
third of all rows is never held as a whole.

Null texts and roles are empty; a null conversation or turn sorts first and is kept. Rows that tie on
conversation and turn are ordered by role, then text. Repeated rows are turns of their own. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import BATCH_ROWS, table, utf8

#: What follows ``<`` or ``[`` in the template's control strings (fixed by the template).
TAILS = (r"s>", r"/s>", r"INST\]", r"/INST\]", r"<SYS>>", r"</SYS>>", r"ROLE=", r"/ROLE\]")
_ESCAPE = re.compile(rf"([<\[])(\\*)({'|'.join(TAILS)})".encode())
_UNESCAPE = re.compile(rf"([<\[])(\\*)\\({'|'.join(TAILS)})".encode())
#: An opening (kind by group), or the start of a conversation.
_OPEN = re.compile(rb"(<s>)|(\[INST\] )|(<<SYS>>)|\[ROLE=([^\]]*)\]")
_CLOSE = {b"user": b" [/INST]", b"system": b"<</SYS>>", b"assistant": b"</s>"}
#: Bytes laid out at once.
PIECE = 1 << 21


def escape(text: bytes) -> bytes:
    return _ESCAPE.sub(rb"\1\2\\\3", text)


def unescape(text: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1\2\3", text)


def _frame(role: str) -> tuple[bytes, bytes]:
    if role == "user":
        return b"[INST] ", b" [/INST]"
    if role == "assistant":
        return b"", b"</s>"
    if role == "system":
        return b"<<SYS>>", b"<</SYS>>"
    return f"[ROLE={quote(role, safe='')}]".encode(), b"[/ROLE]"


def assemble(segments: list[np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of rows made of segments: ``segments[k]`` holds the k-th segments of all rows end to end, ``lengths[row, k]`` their lengths."""
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    begin = ends - lengths
    out = np.empty(int(ends[-1, -1]) if lengths.size else 0, np.uint8)
    for k, data in enumerate(segments):
        size = lengths[:, k]
        source = np.cumsum(size) - size
        lo = 0
        while lo < len(size):  # scatter indices for a bounded number of bytes at a time
            hi = max(lo + 1, int(np.searchsorted(source, source[lo] + PIECE)))
            if hi == lo + 1:
                out[begin[lo, k] : begin[lo, k] + size[lo]] = data[source[lo] : source[lo] + size[lo]]
            else:
                n = int(size[lo:hi].sum())
                target = np.arange(n) + np.repeat(begin[lo:hi, k] - (source[lo:hi] - source[lo]), size[lo:hi])
                out[target] = data[source[lo] : source[lo] + n]
            lo = hi
    return out, np.r_[0, ends[:, -1]] if lengths.size else np.zeros(1, np.int64)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to (conv_id, formatted, loss starts and ends in bytes), one or more parts per conversation."""
    last: object = _format  # no conversation yet
    frames: dict[str, tuple[bytes, bytes]] = {}
    for b in batches:
        if not b.num_rows:
            continue
        convs, roles = b["conv_id"].to_pylist(), b["role"].to_pylist()
        data, offsets = utf8(b["text"])
        if ((data == 60) | (data == 91)).any():  # < or [: only those texts can hold a control string
            plain = b["text"].to_pylist()
            plain = [escape(x.encode()) if "<" in x or "[" in x else x.encode() for x in plain]
            data = np.frombuffer(b"".join(plain), np.uint8)
            sizes = np.array([len(x) for x in plain])
        else:
            sizes = np.diff(offsets)
        starts = [i == 0 and c != last or i > 0 and c != convs[i - 1] for i, c in enumerate(convs)]
        last = convs[-1]
        for r in set(roles):
            frames.setdefault(r, _frame(r))
        heads = [(b"<s>" if new else b"") + frames[r][0] for new, r in zip(starts, roles, strict=True)]
        tails = [frames[r][1] for r in roles]
        lengths = np.stack([[len(x) for x in heads], sizes, [len(x) for x in tails]], axis=1).astype(np.int64)
        out, at = assemble([np.frombuffer(b"".join(heads), np.uint8), data, np.frombuffer(b"".join(tails), np.uint8)], lengths)
        # rows of one conversation side by side are one part
        cut = np.r_[0, np.flatnonzero(starts[1:]) + 1, len(convs)].astype(np.int64)
        cut = np.unique(cut)
        text = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(at[cut].astype(np.int64)), pa.py_buffer(out)])
        learn = np.array([r == "assistant" for r in roles])
        begin = at[:-1] + lengths[:, 0]
        part = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        spans = np.stack([begin, begin + lengths[:, 1]], axis=1) - at[cut[part]][:, None]
        edges = np.r_[0, np.cumsum(np.bincount(part[learn], minlength=len(cut) - 1))].astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(spans[learn, k])) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([b["conv_id"].take(pa.array(cut[:-1])), text.cast(pa.binary()), *lists], ["conv_id", "formatted", "loss_start", "loss_end"])


def formatted(conversations: DataFrame) -> DataFrame:
    """``(conv_id, formatted binary, loss_start array<long>, loss_end array<long>)``: a conversation's parts in order, side by side in one partition."""
    conversations.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format, "conv_id long, formatted binary, loss_start array<long>, loss_end array<long>")


def turns(part: bytes) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a part, unescaped."""
    at = 0
    while at < len(part):
        m = _OPEN.match(part, at)
        if m and m[1]:
            at = m.end()
            continue
        role = b"user" if m and m[2] else b"system" if m and m[3] else None if m else b"assistant"
        at = m.end() if m else at
        close = _CLOSE[role] if role else b"[/ROLE]"
        end = part.index(close, at)
        yield role.decode() if role else unquote(m[4].decode()), unescape(part[at:end]).decode()
        at = end + len(close)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts to one row per conversation, read back from the formatted bytes."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows: list[tuple] = []
    state = None

    def close() -> None:
        if state:
            rows.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

    def put() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in n else pa.int64()) for n, c in zip(names, cols, strict=True)], names)

    for b in batches:
        for conv, part, lo, hi in zip(b["conv_id"].to_pylist(), b["formatted"].to_pylist(), b["loss_start"].to_pylist(), b["loss_end"].to_pylist(), strict=True):
            if state is None or part.startswith(b"<s>"):
                close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in turns(part):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for a, z in zip(lo, hi, strict=True):
                text = unescape(part[a:z])
                state[3] += len(text.decode())
                state[4].update(text)
            state[5] += len(part.decode())
        if len(rows) > 5000:
            yield put()
            rows.clear()
    close()
    yield put()


def digests(parts: DataFrame) -> DataFrame:
    return parts.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return digests(formatted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE=|/ROLE\])', '\1\2\\\3', 'g')) +
  CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 WHEN 'system' THEN 15 ELSE 14 + length(url_encode(role)) END AS size FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) + 3 AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
