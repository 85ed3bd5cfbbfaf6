"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules see one text: words, word characters, symbols, repeated lines and words in repeated
3-word windows. The method sees the corpus: lines are normalised (lower case, digits as 0, white
space runs as one space) and hashed; for each host (``source``) the distinct documents (rows) that hold a
line are counted; a line in more than ``MAX_DOCS`` and more than ``MAX_PERCENT`` percent of the host's documents is
removed; a document left with under ``MIN_WORDS`` words, or under ``MIN_LEFT`` of its words, is depleted
and rejected.

The text is read once into a narrow table; the counts are pre-aggregated before their shuffles, so
a host or text with a third of all rows is not gathered anywhere.

Nulls and empty texts have no words and fail the base rules. A null host is a host of its own.
Repeated rows get one output row each, and each is a document for line frequency. Ties cannot
occur. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import chosen, keyed, spread, stored, table

#: Fixed character classes: white space between words, and symbols.
SPACE = "[ \\t\\n\\x0B\\f\\r]"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
#: Most words in repeated windows, in percent.
MAX_REPEAT = 50
WINDOW = 3
#: A line may stand in so many documents of its host, or in this part of them, whichever is more.
MAX_DOCS = 5
MAX_PERCENT = 10
MIN_LEFT = 0.5


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _windows(w: Column) -> Column:
    """Sorted longs, one for each 3-word window: its hash shifted left past the bits of its place, and its place."""
    last = F.size(w) - WINDOW
    bits = F.ceil(F.log2(F.size(w) + 1)).cast("int")
    return F.when(
        last >= 1,
        F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: F.call_function("shiftleft", _hash(*(F.get(w, i + k) for k in range(WINDOW))), bits).bitwiseOR(i.cast("long")))),
    )


def _spelled(w: Column) -> Column:
    """Sorted places of all windows found twice or more, told apart by their words alone."""
    gram = lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(WINDOW)))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(gram(i).alias("g"), i.alias("i"))))
    near = lambda o, j, d: F.coalesce(F.get(o, j)["g"] == F.get(o, j + d)["g"], F.lit(False))
    twice = lambda o: F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda j: near(o, j, 1) | ((j > 0) & near(o, j, -1)))
    places = F.transform(F.array(order), lambda o: F.transform(twice(o), lambda j: F.get(o, j)["i"]))
    return F.sort_array(F.flatten(places))


def base(docs: DataFrame) -> DataFrame:
    """(row, doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines array<struct<h, words>>)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    at = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), text.alias("text")))
    at = at.select("*", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("l"))
    at = at.select("*", _windows(F.col("w")).alias("s"))
    # neighbours in the order of the hashes; the words themselves decide whether they are the same window
    s, w = F.col("s"), F.col("w")
    bits = F.ceil(F.log2(F.size(w) + 1)).cast("int")
    key = lambda x: F.call_function("shiftright", x, bits)
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
    same = lambda a, b: (F.get(w, a) == F.get(w, b)) & (F.get(w, a + 1) == F.get(w, b + 1)) & (F.get(w, a + 2) == F.get(w, b + 2))
    met = F.filter(F.sequence(F.lit(0), F.size(s) - 2), lambda j: key(F.get(s, j)) == key(F.get(s, j + 1)))
    at = at.select("*", F.when(s.isNotNull(), met).alias("e"))
    e = F.col("e")
    clash = F.exists(e, lambda j: ~same(place(F.get(s, j)), place(F.get(s, j + 1))))
    spots = F.sort_array(F.array_distinct(F.concat(F.transform(e, lambda j: place(F.get(s, j))), F.transform(e, lambda j: place(F.get(s, j + 1))))))
    # different windows of one hash: that text's windows are told apart by their words instead
    at = at.select("*", F.when(F.size(e) > 0, F.when(clash, _spelled(w)).otherwise(spots)).alias("c"))
    c = F.col("c")
    covered = F.when(F.size(c) > 0, F.aggregate(F.sequence(F.lit(1), F.size(c)), F.lit(0).cast("long"), lambda a, k: a + F.least(F.lit(WINDOW), F.coalesce(F.get(c, k) - F.get(c, k - 1), F.lit(WINDOW)))))
    plain = lambda x: F.lower(F.regexp_replace(F.trim(F.regexp_replace(x, SPACE + "+", " ")), "[0-9]", "0"))
    l_ = F.col("l")
    return at.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "host",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS + "+", ""))).cast("long").alias("n_symbols"),
        (F.size(l_) - F.size(F.array_distinct(l_))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform(l_, lambda x: F.struct(F.xxhash64(plain(x)).alias("h"), F.size(words(x)).alias("words"))).alias("lines"),
    )


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, max_percent: int = MAX_PERCENT) -> DataFrame:
    """The base columns of :func:`base` without lines, with base_failed, n_left (words left) and kept."""
    read = stored(base(docs), "quality")
    bad_base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    host = F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))
    limits = read.groupBy(host.alias("host")).agg(F.count("*").alias("docs"))
    often = read.select(host.alias("host"), F.explode(F.array_distinct(F.col("lines.h"))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs)
    often = often.join(limits, "host").filter(100 * F.col("n") > max_percent * F.col("docs")).select("host", "h")
    lines = read.select("row", host.alias("host"), F.explode("lines").alias("x")).select("row", "host", F.col("x.h").alias("h"), F.col("x.words").alias("words"))
    lost = lines.join(often, ["host", "h"]).groupBy("row").agg(F.sum("words").alias("lost"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    depleted = (left < MIN_WORDS) | (left < MIN_LEFT * F.col("n_words"))
    return read.drop("lines").join(lost, "row", "left").select("*", bad_base.alias("base_failed"), left.cast("long").alias("n_left"), (~bad_base & ~depleted).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with their columns as they are; ids may be null or repeat."""
    rows = keyed(docs)
    poor = stored(judge(rows.withColumn("doc_id", F.col("__cl_row"))).filter("NOT kept").select(F.col("doc_id").alias("__cl_row")), "poor")
    return chosen(rows, poor, "__cl_row", out=True).select(*docs.columns)


SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, coalesce('=' || source, '') AS host FROM documents),
w AS (SELECT doc_id, rid, t, host, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
g AS (SELECT rid, p, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM x WINDOW o AS (PARTITION BY rid ORDER BY p)),
r AS (SELECT rid, p FROM g WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, count(DISTINCT p + o) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY rid),
l AS (SELECT rid, host, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT rid, host, line, lower(regexp_replace(trim(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '[0-9]', '0', 'g')) AS plain,
  len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM l WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')),
u AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM m GROUP BY rid),
h AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
f AS (SELECT host, plain FROM m JOIN h USING (host) GROUP BY host, plain, docs HAVING count(DISTINCT rid) > 5 AND 100 * count(DISTINCT rid) > 10 * docs),
z AS (SELECT rid, sum(n) AS lost FROM m JOIN f USING (host, plain) GROUP BY rid),
b AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  len(w) - coalesce(lost, 0) AS n_left
  FROM w LEFT JOIN c USING (rid) LEFT JOIN u USING (rid) LEFT JOIN z USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_left < 50 OR n_left < 0.5 * n_words) AS kept
FROM b
"""
