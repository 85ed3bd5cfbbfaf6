"""Main text of web pages by union-free wrappers inferred from pages of the same host.

1. A page is read into tokens: block tags (with their class and id words) and texts; inline markup
   is part of a text. Ends that pages leave out are supplied. A text carries its place, the open elements around
   it, as a hash and a kind: inside an article (or main part), inside a menu, header, footer, sidebar,
   notice, advert, form or comments, or neither.
2. The page is folded: stretches of elements that repeat side by side become a repeated group ``(...)+``.
   Equal folded streams of a host are one.
3. A host's wrapper is inferred by aligning its streams one after the other (longest common subsequences): equal
   tokens stay, a stretch that repeats what stands before it becomes a repeated group, any other mismatch an
   optional group ``(...)?``. Of a text's node the wrapper keeps on how many streams it was found and which texts all
   of them have there: these are the template's own, any other text fills a slot. Hosts of many streams are aligned
   in parts of ``PART``, and the parts' wrappers in turn.
4. The main text of a page is the text inside its article. Of a page without one it is the text of neither kind that
   fills a slot: what the wrapper holds as the template's own (on ``LEAST`` streams or more, as two may be copies of each
   other) is left out.

Wrappers are joined to pages by host: by broadcast while their measured size allows, else by shuffle.

Null html gives an empty text. A null or broken URL has the empty host. Repeated rows get one output row
each. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, hot_join, spread, stored, table, tidy

#: Elements that are part of the running text (fixed by HTML).
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is not text of the page.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "object", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key closes an open element of the values.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements and class or id words of what is not main text.
BOILERPLATE_TAGS = frozenset("nav header footer aside form button select head dialog menu".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
CONTENT_TAGS = frozenset(("article", "main"))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-zA-Z]+")
#: Streams aligned by one task in one round.
PART = 256
#: Streams that must share a text for it to be the template's own.
LEAST = 3
BROADCAST_BYTES = 8 << 20


def host_of(url: str | None) -> str:
    try:
        return (urlsplit((url or "").strip()).hostname or "").lower()
    except ValueError:
        return ""


def _inner(place: tuple[str, bool, bool], element: str) -> tuple[str, bool, bool]:
    """(hash, whether inside an article, whether in what is not main text) of the place inside an element."""
    above, inside, out = place
    name, *words = element.split(".")
    inside = inside or name in CONTENT_TAGS or any(w in CONTENT_TAGS for w in words)
    out = out or (name in BOILERPLATE_TAGS and not (inside and name == "header"))
    out = out or (name not in ("body", "html") and any(w in BOILERPLATE_WORDS and not (inside and w == "header") for w in words))
    return xxhash.xxh64_hexdigest(f"{above}/{element}".encode()), inside, out


def placed(tokens: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """The tokens with the place of each text: a for inside an article, b for not main text, o for neither, and a hash."""
    stack = [("", False, False)]
    out = []
    for kind, value in tokens:
        if kind == "<":
            stack.append(_inner(stack[-1], value))
        elif kind == ">":
            stack.pop()
        above, inside, left_out = stack[-1]
        out.append((kind, value, ("b" if left_out else "a" if inside else "o") + above if kind == "#" else ""))
    return out


def block(text: str) -> str:
    """A text with its character references decoded and white space turned to single spaces."""
    return " ".join(entities.unescape(text).split())


def read(page: str) -> list[tuple[str, str]]:
    """Tokens: ("<", element with its boilerplate words), (">", element) and ("#", text, undecoded)."""
    out: list[tuple[str, str]] = []
    opened: list[str] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            if (joined := "".join(text)).strip():
                out.append(("#", joined))
            text.clear()

    def close(to: int) -> None:
        while len(opened) > to:
            out.append((">", opened.pop()))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name in ("br", "wbr", "img"):
                text.append(" ")
            continue
        flush()
        if m[2]:
            for i in range(len(opened) - 1, -1, -1):
                if opened[i].split(".")[0] == name:
                    close(i)
                    break
            continue
        ends = CLOSES.get(name, frozenset()) | ({"p"} if name in ENDS_P else frozenset())
        for i in range(len(opened) - 1, -1, -1):
            base = opened[i].split(".")[0]
            if base not in ends:
                if base in ("p", "li", "td", "th", "tr", "dt", "dd") and ends:
                    continue
                break
            close(i)
        words = sorted({w for v in _NAMED.findall(m[4] or "") for w in _WORD.findall("".join(v).lower()) if w in BOILERPLATE_WORDS or w in CONTENT_TAGS})
        element = ".".join([name, *words])
        out.append(("<", element))
        if name in VOID:
            out.append((">", element))
        else:
            opened.append(element)
    text.append(page[at:])
    flush()
    close(0)
    return out


# A node is ["<", element], [">", element], ["#", place, streams, texts that all of them have here], ["+", nodes] or ["?", nodes].


def key(node: list) -> str:
    """What makes nodes equal: all but the texts."""
    return f"{node[0]}{node[1]}" if node[0] in "<>#" else f"{node[0]}({' '.join(map(key, node[1]))})"


def blend(a: list, b: list, across: bool) -> list:
    """Two equal nodes as one: of different streams (``across``), or of two stretches of one stream."""
    if a[0] == "#":
        both = set(a[3]) & set(b[3]) if across else set(a[3]) | set(b[3])
        return ["#", a[1], a[2] + b[2] if across else a[2], sorted(both)]
    if a[0] in "+?":
        return [a[0], [blend(x, y, across) for x, y in zip(a[1], b[1], strict=True)]]
    return a


def fold(units: list[tuple[str, list]]) -> list[tuple[str, list]]:
    """Siblings, as (key, nodes), with stretches that repeat side by side as one ["+", nodes]."""
    out: list[tuple[str, list]] = []
    body: dict[int, list[str]] = {}  # place of a group: its siblings' keys
    seen: dict[str, list[int]] = {}  # key: its places

    def drop(n: int) -> None:
        for at in range(len(out) - n, len(out)):
            seen[out[at][0]].pop()
            body.pop(at, None)
        del out[len(out) - n :]

    def put(unit: tuple[str, list], keys: list[str] | None = None) -> None:
        if keys is not None:
            body[len(out)] = keys
        seen.setdefault(unit[0], []).append(len(out))
        out.append(unit)

    def equal(n: int) -> bool:
        return all(out[-k][0] == out[-k - n][0] for k in range(1, n + 1))

    def group(parts: list[list]) -> list:
        nodes = parts[0]
        for more in parts[1:]:
            nodes = [blend(x, y, False) for x, y in zip(nodes, more, strict=True)]
        return nodes

    def nodes_of(part: list[tuple[str, list]]) -> list:
        return [n for _, nodes in part for n in nodes]

    for unit in units:
        put(unit)
        changed = True
        while changed:
            changed = False
            at = next((p for p in sorted(body, reverse=True) if p < len(out) - 1), None)
            if at is not None and body[at] == [k for k, _ in out[at + 1 :]]:  # once more what a group holds
                keys = body[at]
                whole = ["+", group([out[at][1][0][1], nodes_of(out[at + 1 :])])]
                drop(len(out) - at)
                put(("+" + " ".join(keys), [whole]), keys)
                changed = True
                continue
            for p in reversed(seen[out[-1][0]][:-1]):
                n = len(out) - 1 - p
                if 2 * n > len(out):
                    break
                if (n > 1 or out[-1][1][0][0] != "#") and equal(n):
                    keys = [k for k, _ in out[-n:]]
                    whole = ["+", group([nodes_of(out[-2 * n : -n]), nodes_of(out[-n:])])]
                    drop(2 * n)
                    put(("+" + " ".join(keys), [whole]), keys)
                    changed = True
                    break
    return out


def stream(tokens: list[tuple[str, str]]) -> list:
    """The folded stream of a page, element by element."""
    levels: list[tuple[str, list[tuple[str, list]]]] = [("", [])]
    for kind, value, place in placed(tokens):
        if kind == "<":
            levels.append((value, []))
        elif kind == ">":
            element, children = levels.pop()
            folded = fold(children)
            nodes = [["<", element], *(n for _, ns in folded for n in ns), [">", element]]
            levels[-1][1].append((xxhash.xxh64_hexdigest(" ".join([element, *(k for k, _ in folded)]).encode()), nodes))
        else:
            # texts are told apart only where the wrapper has to decide
            texts = [xxhash.xxh64_hexdigest(x.encode())] if place[0] == "o" and (x := block(value)) else []
            levels[-1][1].append((f"#{place}", [["#", place, 1, texts]]))
    return [n for _, nodes in fold(levels[0][1]) for n in nodes]


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of a longest common subsequence of ``b`` with each prefix of ``a``, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.r_[0, np.cumsum(bits == 0)]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places: halves are split where their lengths add up best, so memory stays linear."""
    out: list[tuple[int, int]] = []

    def search(lo: int, hi: int, left: int, right: int) -> None:
        while lo < hi and left < right and a[lo] == b[left]:
            out.append((lo, left))
            lo, left = lo + 1, left + 1
        ends = []
        while lo < hi and left < right and a[hi - 1] == b[right - 1]:
            hi, right = hi - 1, right - 1
            ends.append((hi, right))
        if lo < hi and left < right:
            if right - left == 1:
                if b[left] in a[lo:hi]:
                    out.append((a.index(b[left], lo, hi), left))
            else:
                middle = (left + right) // 2
                first = _lengths(a[lo:hi], b[left:middle])
                last = _lengths(a[lo:hi][::-1], b[middle:right][::-1])[::-1]
                cut = lo + int(np.argmax(first + last))
                search(lo, cut, left, middle)
                search(cut, hi, middle, right)
        out.extend(reversed(ends))

    search(0, len(a), 0, len(b))
    return out


def balanced(nodes: list) -> bool:
    depth = 0
    for n in nodes:
        depth += (n[0] == "<") - (n[0] == ">")
        if depth < 0:
            return False
    return depth == 0


def align(a: list, b: list) -> list:
    """A wrapper that generates what the wrappers a and b generate; aligning a part of it again changes no structure."""
    flat = [[x for n in w for x in ([(m, True) for m in n[1]] if n[0] == "?" else [(n, False)])] for w in (a, b)]
    keys = [[key(n) for n, _ in w] for w in flat]
    out: list[tuple[list, bool]] = []

    def repeated(inner: list, other: list) -> list:
        return ["+", [blend(x, y, True) for x, y in zip(inner, other, strict=True)]]

    def mismatch(part: list[tuple[list, bool]]) -> None:
        nodes = [n for n, _ in part]
        inner = nodes[0][1] if len(nodes) == 1 and nodes[0][0] == "+" else nodes
        names = [key(n) for n in inner]
        before = out[-len(inner) :]
        if not any(o for _, o in before) and [key(n) for n, _ in before] == names and balanced(inner):
            del out[-len(inner) :]
            out.append((repeated([n for n, _ in before], inner), False))  # what stands before repeats
        elif out and out[-1][0][0] == "+" and [key(n) for n in out[-1][0][1]] == names:
            out[-1] = (repeated(out[-1][0][1], inner), out[-1][1])
        else:
            out.extend((n, True) for n in nodes)

    i = j = 0
    for x, y in [*common(*keys), (len(flat[0]), len(flat[1]))]:
        parts = [p for p in (flat[0][i:x], flat[1][j:y]) if p]
        bodies = [p[0][0][1] if len(p) == 1 and p[0][0][0] == "+" else None for p in parts]
        plain = [[n for n, _ in p] if body is None else body for p, body in zip(parts, bodies, strict=True)]
        if len(parts) == 2 and any(body is not None for body in bodies) and [key(n) for n in plain[0]] == [key(n) for n in plain[1]]:
            out.append((repeated(*plain), any(o for p in parts for _, o in p)))  # once on one side, again and again on the other
        else:
            for part in parts:
                mismatch(part)
        if x < len(flat[0]):
            out.append((blend(flat[0][x][0], flat[1][y][0], True), flat[0][x][1] or flat[1][y][1]))
        i, j = x + 1, y + 1
    grouped: list = []
    for node, optional in out:
        if not optional:
            grouped.append(node)
        elif grouped and grouped[-1][0] == "?":
            grouped[-1][1].append(node)
        else:
            grouped.append(["?", [node]])
    return grouped


def constants(wrapper: list, least: int = LEAST) -> set[tuple[str, str]]:
    """(place, text's hash) of the template's own texts."""
    found: set[tuple[str, str]] = set()
    for n in wrapper:
        if n[0] == "#" and n[2] >= least:
            found.update((n[1], h) for h in n[3])
        elif n[0] in "+?":
            found |= constants(n[1], least)
    return found


@lru_cache(maxsize=256)
def _constants(wrapper: str) -> frozenset[tuple[str, str]]:
    return frozenset(constants(json.loads(wrapper)))


def main_text(page: str, wrapper: str = "[]") -> str:
    """The main text of a page of the wrapper's host."""
    texts = [(place, x) for kind, value, place in placed(read(page)) if kind == "#" and (x := block(value))]
    if any(place[0] == "a" for place, _ in texts):
        return "\n\n".join(x for place, x in texts if place[0] == "a")
    own = _constants(wrapper)
    return "\n\n".join(x for place, x in texts if place[0] == "o" and (place, xxhash.xxh64_hexdigest(x.encode())) not in own)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [json.dumps(stream(read(x or ""))) for x in b["html"].to_pylist()]
        hosts = [host_of(u) for u in b["url"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(made, pa.string())], ["host", "stream"])


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted by (host, salt) to one wrapper each; only the wrapper so far is held."""
    last, wrapper = None, None
    rows: list[tuple] = []
    for b in batches:
        for host, salt, text in zip(b["host"].to_pylist(), b["salt"].to_pylist(), b["stream"].to_pylist(), strict=True):
            if (host, salt) != last:
                if wrapper is not None:
                    rows.append((last[0], json.dumps(wrapper)))
                last, wrapper = (host, salt), json.loads(text)
            else:
                wrapper = align(wrapper, json.loads(text))
    if wrapper is not None:
        rows.append((last[0], json.dumps(wrapper)))
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["host", "stream"])


def wrappers(pages: DataFrame, part: int = PART) -> DataFrame:
    """``(host, wrapper)`` of all hosts, from all their pages; each round leaves a wrapper for every ``part`` streams of a host."""
    each = stored(pages.mapInArrow(tidy(_streams), "host string, stream string").distinct(), "streams")
    while True:
        sizes = each.groupBy("host").agg(F.count("*").alias("n"))
        most, total = sizes.agg(F.max("n"), F.sum("n")).first()
        if (most or 0) <= 1:
            return each.withColumnRenamed("stream", "wrapper")
        salt = F.pmod(F.xxhash64("stream"), F.ceil(F.col("n") / part))
        salted = hot_join(each, sizes, "host", "n", total).select("host", salt.alias("salt"), "stream").repartition("host", "salt").sortWithinPartitions("host", "salt", "stream")
        each = stored(salted.mapInArrow(tidy(_infer), "host string, stream string"), "wrappers")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x, w or "[]") for x, w in zip(b["html"].to_pylist(), b["wrapper"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    batches_of(pages.sparkSession)
    rows = spread(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")))
    known = wrappers(rows)
    size = known.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    named = rows.mapInArrow(_hosts, "page_id long, url string, html string, host string")
    joined = named.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", "left")
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(tidy(_extract), "page_id long, url string, text string, n_chars long")


def _hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.append_column("host", pa.array([host_of(u) for u in b["url"].to_pylist()], pa.string()))


def op10_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
