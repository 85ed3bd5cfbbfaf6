"""Spelling suggestions: the closest vocabulary word for each unknown query word."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTOFF = 0.7


def suggest(vocab: DataFrame, query: str, cutoff: float = CUTOFF) -> str | None:
    """The query with unknown words replaced by their closest term (ratio of at least ``cutoff``), or None.

    Candidates are compared where they lie; only the best of each partition travels.
    """
    words = query.split()
    known = {r["term"] for r in vocab.filter(F.col("term").isin(words)).select("term").distinct().collect()} if words else set()
    unknown = sorted({w for w in words if w not in known})
    if not unknown:
        return None

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top: dict[str, tuple[float, str]] = {}
        for frame in frames:
            for term in frame["term"]:
                for w in unknown:
                    if 2 * min(len(w), len(term)) < cutoff * (len(w) + len(term)):
                        continue
                    match = SequenceMatcher(None, term, w)
                    if match.real_quick_ratio() >= cutoff and match.quick_ratio() >= cutoff and (ratio := match.ratio()) >= cutoff:
                        top[w] = max(top.get(w, (0.0, "")), (ratio, term))
        yield pd.DataFrame([(w, r, t) for w, (r, t) in top.items()], columns=["word", "ratio", "term"])

    found = vocab.select("term").mapInPandas(best, "word string, ratio double, term string").groupBy("word").agg(F.max(F.struct("ratio", "term")).alias("b")).collect()
    fixes = {r["word"]: r["b"]["term"] for r in found}
    if not fixes:
        return None
    return " ".join(fixes.get(w, w) for w in words)


def worth_showing(query: str, suggestion: str | None) -> bool:
    return suggestion is not None and suggestion.lower() != query.lower()
