"""Text expressions: terms, chunks, previews, admission."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.functions.constants import BOILERPLATE, CHUNK_BYTES, PIECE_BYTES, STOPWORDS, TURN_REACH

TERM = r"[\p{L}\p{N}]+"


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def terms(c: str | Column) -> Column:
    """Lower-cased runs of letters and digits, in order; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(column(c), F.lit(""))), F.lit(TERM), F.lit(0))


def query_words(query: str, strict: bool) -> list[str]:
    """The words of a keyword query; a strict one leaves stopwords out unless nothing else is left."""
    words = query[:10000].split()
    content = [w for w in words if w.lower() not in STOPWORDS]
    return content if strict and content else words


def query_phrases(query: str, strict: bool) -> list[list[str]]:
    """Each word of a query as the terms it is made of; a word of several terms is a phrase."""
    import regex

    phrases = [regex.findall(TERM, w.lower()) for w in query_words(query, strict)]
    return [p for p in phrases if p]


def phrase_count(tokens: Column, phrase: list[str]) -> Column:
    """How often the terms of a phrase stand in a row."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    # terms hold no spaces and no pattern characters; looking ahead finds occurrences that overlap too
    row = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.regexp_count(row, F.lit(f"(?= {' '.join(phrase)} )"))


def preview(c: str | Column, length: int = 200) -> Column:
    return F.substring(column(c), 1, length)


def normalised_name(c: str | Column) -> Column:
    """Trimmed and lower-cased, at most 255 characters."""
    return F.substring(F.lower(F.trim(column(c))), 1, 255)


def normalised_answer(c: str | Column) -> Column:
    """Lower-cased, with one space for each run of what is no letter, digit or underscore; nothing at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(column(c), F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def admitted(c: str | Column) -> Column:
    """Whether a text is worth storing: long enough, also without outer spaces and final punctuation, and no small talk."""
    plain = F.substring(F.regexp_replace(F.lower(F.regexp_replace(column(c), r"^[ \t\r\n]+|[ \t\r\n]+$", "")), "[.!?]+$", ""), 1, 255)
    return F.coalesce((F.octet_length(column(c)) >= 10) & (F.octet_length(plain) >= 10) & ~plain.isin(*BOILERPLATE), F.lit(False))


def pieces(c: str | Column, size: int) -> Column:
    """A text in pieces of ``size`` characters; none for an empty text."""
    text = column(c)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def chunks(c: str | Column, strategy: str = "paragraph", size: int = PIECE_BYTES) -> Column:
    """A text split at lines, pages or blank lines (``none``: not at all), empty parts dropped, long parts cut to ``size``."""
    if strategy == "none":
        return F.array(column(c))
    mark = {"line": "\n", "page": "\f"}.get(strategy, "\n\n")
    return F.flatten(F.transform(F.split(column(c), mark, -1), lambda part: pieces(part, size if size > 0 else PIECE_BYTES)))


def turn_chunks(text: str | None, most: int | None = None) -> list[tuple[int, int]]:
    """(offset, length) of passages of about 800 characters, cut before a speaker's turn where one is near; none if one passage is enough.

    All of the text is covered, unless ``most`` ends it after so many passages.
    """
    out, at, n = [], 0, len(text or "")
    if n < CHUNK_BYTES:
        return []
    while at < n and (most is None or len(out) < most):
        end = min(at + CHUNK_BYTES, n)
        if at + CHUNK_BYTES < n:
            window = range(max(end - TURN_REACH, 0), min(end + TURN_REACH, n))
            turns = (i + 1 for i in window if text[i] == "\n" and text.startswith(("User:", "Assistant:"), i + 1))
            turn = next(turns, 0)
            end = turn if turn > at else end
        out.append((at, end - at))
        at = end
    return out if len(out) > 1 else []
