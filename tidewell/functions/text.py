"""Text derivations as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

# The 29 characters that count as white space.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
# Characters that end a line (CR LF is one end).
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
SIDECAR_SUFFIX = ".transcript.txt"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), rf"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column | str) -> Column:
    """White-space runs as one space, none at the ends."""
    return F.btrim(F.regexp_replace(_col(text), rf"{SPACE}+", " "))


def word_count(text: Column | str) -> Column:
    flat = collapse(text)
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " "))).cast("int")


def anchor(seconds: Column | str) -> Column:
    """MM:SS, or HH:MM:SS from one hour; truncated, never negative, fields widen past two digits."""
    total = F.greatest(F.lit(0).cast("bigint"), _col(seconds).cast("bigint"))
    hours, minutes, rest = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    short = F.format_string("%02d:%02d", minutes.cast("bigint"), rest)
    return F.when(hours > 0, F.concat(F.format_string("%02d:", hours.cast("bigint")), short)).otherwise(short)


def lead_sentence(text: Column | str) -> Column:
    """Up to the first full stop and space of the collapsed text, with exactly one full stop."""
    return F.concat(F.regexp_replace(F.substring_index(collapse(text), ". ", 1), r"\.+$", ""), F.lit("."))


def summary(first_text: Column | str, first_start: Column | str, words: Column | str) -> Column:
    """Anchor, lead sentence and word count in one line."""
    return F.concat(F.lit("[t="), anchor(first_start), F.lit("] "), lead_sentence(first_text), F.lit(" ("), _col(words).cast("string"), F.lit(" words)"))


def summary_document(first_text: Column | str, first_start: Column | str, words: Column | str, method: Column | str) -> Column:
    """The summary as a document: anchor and lead, word count, and by which method the transcript was made."""
    lead = F.concat(F.lit("[t="), anchor(first_start), F.lit("] "), lead_sentence(first_text))
    # Headings and wording of the document.
    note = F.concat(F.lit("Transcript method: "), _col(method), F.lit(". Summary is an extractive lead with timestamp provenance, not a faithfulness claim.\n"))
    return F.concat(F.lit("# Summary\n\n"), lead, F.lit("\n\nWords: "), _col(words).cast("string"), F.lit("\n\n"), note)


def stem(name: Column | str) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(_col(name), r"(?<=[^/])\.[^./]*$", "")


def suffix(name: Column | str) -> Column:
    """Lower-cased last suffix with its dot, or empty."""
    return F.lower(F.regexp_extract(_col(name), r"[^/](\.[^./]+)$", 1))


def sidecar_name(name: Column | str) -> Column:
    return F.concat(stem(name), F.lit(SIDECAR_SUFFIX))


def title(name: Column | str) -> Column:
    """The stem with underscores as spaces; a letter is a capital unless a cased letter stands before it."""
    chars = F.split(F.replace(stem(name), F.lit("_"), F.lit(" ")), "")
    # Classes of cased letters, and the marks and numerals that have case.
    cased = r"[\p{Lu}\p{Ll}\p{Lt}ªºⅠ-ⅿⓐ-ⓩⒶ-Ⓩ]"
    one = lambda c, i: F.when((i > 0) & F.get(chars, i - 1).rlike(cased), F.lower(c)).otherwise(F.upper(c))
    return F.array_join(F.transform(chars, one), "")


def is_remote(text: Column | str) -> Column:
    """Whether the text, blanks aside, is an http or https address."""
    flat = F.lower(strip(text))
    return flat.startswith("http://") | flat.startswith("https://")


def command_is_remote(tokens: Column | str) -> Column:
    """Whether any argument of a command is a remote address."""
    return F.exists(_col(tokens), is_remote)


def blank_to_null(text: Column | str) -> Column:
    return F.nullif(strip(text), F.lit(""))


def lines(text: Column | str) -> Column:
    """Lines without their ends; no empty one after a final line end, none for an empty text."""
    parts = F.split(_col(text), LINE_END)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return whole


def reviewer_name(login: Column | str) -> Column:
    return F.regexp_replace(_col(login), r"\[bot\]$", "")


def word_distance(reference: Column | str, candidate: Column | str) -> Column:
    """Levenshtein distance between two arrays of words, row by row of the edit table; quadratic in the lengths."""
    a, b = _col(reference), _col(candidate)
    start = F.transform(F.array_append(b, F.lit("")), lambda _, j: j)

    def row(held: Column, word: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            cost = F.when(F.get(b, j) == word, 0).otherwise(1)
            best = F.least(F.get(held, j) + cost, F.get(held, j + 1) + 1, F.element_at(done, -1) + 1)
            return F.array_append(done, best)

        return F.aggregate(F.transform(b, lambda _, j: j), F.array(F.get(held, F.lit(0)) + 1), cell)

    return F.element_at(F.aggregate(a, start, row), -1)


def word_accuracy(reference: Column | str, candidate: Column | str) -> Column:
    """1 - distance / reference words, at least 0; an empty reference gives 1 for an empty candidate, else 0."""
    split = lambda c: F.filter(F.split(collapse(c), " "), lambda w: w != "")
    a, b = split(reference), split(candidate)
    share = F.greatest(F.lit(0.0), 1 - word_distance(a, b) / F.size(a))
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).otherwise(share)


def distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Levenshtein distance of two lists of words, a column of the edit table at a time as bits of whole numbers.

    The numbers hold, for each word of `a`, whether the table rises or falls there; a step takes
    a few operations on len(a) bits, so 20,000 words against as many take some ten million word operations.
    """
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    whole, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, total = whole, 0, len(a)
    for word in b:
        same = places.get(word, 0)
        free = same | down
        zero = (((same & up) + up) ^ up) | same
        rise, fall = (down | ~(zero | up)) & whole, up & zero
        total += bool(rise & last) - bool(fall & last)
        rise = (rise << 1 | 1) & whole
        fall = fall << 1 & whole
        up, down = (fall | ~(free | rise)) & whole, rise & free
    return total


def word_accuracy_of_long_texts(reference: Column | str, candidate: Column | str) -> Column:
    """`word_accuracy` for texts of tens of thousands of words, in Arrow batches of Python."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)

    @F.pandas_udf("double")
    def run(references: pd.Series, candidates: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(references, candidates, strict=True):
            a, b = list(x), list(y)
            out.append(max(0.0, 1 - distance(a, b) / len(a)) if a else float(not b))
        return pd.Series(out, dtype="float64")

    split = lambda c: F.coalesce(F.filter(F.split(collapse(c), " "), lambda w: w != ""), F.array().cast("array<string>"))
    return run(split(reference), split(candidate))
