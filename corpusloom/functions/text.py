"""Text expressions: all run inside Catalyst, none in Python."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.stopwords import STOPWORDS

# Letters that are lower-cased, white space, and the letters that stay.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÁÉÍÓÚÑÜ"
LOWER = "abcdefghijklmnopqrstuvwxyzáéíóúñü"
WHITE = " \\t\\n\\x0B\\f\\r"
LETTERS_ONLY = "A-Za-zÁ-Üá-ü"
LETTERS = LETTERS_ONLY + "0-9" + WHITE
MIN_BYTES = 2


def lowered(text: Column) -> Column:
    """Lower-case A-Z and the accented letters of Spanish only."""
    return F.translate(text, UPPER, LOWER)


def without_specials(text: Column) -> Column:
    """Every character that is no letter, digit or white space as a space."""
    return F.regexp_replace(text, f"[^{LETTERS}]", " ")


def without_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]", "")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != "")


def without_stopwords(words: Column, more: Iterable[str] = ()) -> Column:
    stop = [*STOPWORDS, *(w.strip().lower() for w in more)]
    return F.filter(words, lambda w: ~w.isin(stop))


def without_short(words: Column, least: int = MIN_BYTES) -> Column:
    """Words of ``least`` bytes or more (bytes, not characters)."""
    return F.filter(words, lambda w: F.octet_length(w) >= least)


def tokens(text: Column, keep_numbers: bool = False, more_stopwords: Iterable[str] = (), least: int = MIN_BYTES) -> Column:
    """The whole chain: lower, specials, digits, split, stop-words, short words."""
    return F.filter(parts(text, keep_numbers), lambda w: counts(w, more_stopwords, least))


def parts(text: Column, keep_numbers: bool = False) -> Column:
    """Words before stop-words and short ones go, and maybe empty ones: digits are deleted, then all but letters splits.

    The same as :func:`without_specials`, :func:`without_digits` and :func:`split_words` in turn, in fewer passes.
    """
    plain = lowered(text)
    return F.split(plain, f"[^{LETTERS_ONLY}0-9]+") if keep_numbers else F.split(without_digits(plain), f"[^{LETTERS_ONLY}]+")


def counts(word: Column, more_stopwords: Iterable[str] = (), least: int = MIN_BYTES) -> Column:
    """Whether a word stays: long enough, and no stop-word."""
    stop = [*STOPWORDS, *(w.strip().lower() for w in more_stopwords)]
    return (F.octet_length(word) >= max(1, least)) & ~word.isin(stop)


def is_phrase(query: str) -> bool:
    return len(query) >= 2 and query[0] == query[-1] == '"'


def preview(text: Column, length: int = 200, missing: str = "(no text)") -> Column:
    cut = F.concat(F.translate(F.substring(text, 1, length), "\n", " "), F.lit("..."))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(missing)).otherwise(cut)


def kilobytes(size: Column) -> Column:
    return F.round(size / 1024, 1)


def density(unique: Column, total: Column) -> Column:
    """Lexical density (and type-token ratio): unique over total, 0 without tokens."""
    return F.when(total > 0, unique / total).otherwise(F.lit(0.0))
