"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import functools
import math
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, own_names, table

_GAP = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
#: A few very common words of the languages kept; one in a text is enough.
COMMON = ("the of and to in is that for with on as was be this are it at by from or "
          "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
          "de la le et les des en un une du que est pour qui dans par sur au plus pas "
          "el los las del se por una con para su al lo como más").split()  # fmt: skip


@dataclass(frozen=True)
class Rule:
    """A name and the condition under which a text is rejected."""

    name: str
    rejects: Column


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _GAP), lambda w: w != "")


def _ratio(text: Column, pattern: str) -> Column:
    """Code points that match `pattern`, over all; null for an empty text."""
    return F.try_divide(F.length(text) - F.length(F.regexp_replace(text, pattern, "")), F.length(text))


def rules() -> list[Rule]:
    """Rules over `text` and the base counts; null conditions don't reject."""
    text, n = F.col("text"), F.col("n_words")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("repeated_lines", (F.col("n_dup_lines") >= 3) & (2 * F.col("n_dup_lines") > F.col("n_lines"))),
        Rule("stutter", 5 * let(_words(text), lambda ws: F.size(F.filter(ws, lambda w, i: (i > 0) & (w == F.get(ws, i - 1))))) > n),
        Rule("capitals", _ratio(text, r"\p{Lu}+") > 0.4),
        Rule("few_letters", _ratio(text, r"\p{L}+") < 0.5),
        Rule("exclamation", F.length(F.regexp_replace(text, r"[^!?]+", "")) * 5 > n),
        Rule("bullets", F.coalesce(_share(text, lambda line: line.rlike(r"^[ \t]*[-*•·] ")) > 0.9, F.lit(False))),
        Rule("ellipsis", F.coalesce(_share(text, lambda line: line.rlike(r"(\.\.\.|…)\s*$")) > 0.3, F.lit(False))),
        Rule("no_common_word", ~F.arrays_overlap(F.transform(_words(text), F.lower), F.array(*map(F.lit, COMMON)))),
    ]


def _share(text: Column, test) -> Column:
    return let(_lines(text), lambda lines: F.try_divide(F.size(F.filter(lines, test)), F.size(lines)))


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words that lie in a window of `window` words found twice or more in `words`.

    Windows are hashed and compared as 64-bit numbers.  Only if some repeat, positions are
    sorted by hash, those equal to a neighbour are kept, and each covers the words up to the
    next one kept, `window` at most.
    """
    at = F.sequence(F.lit(1), F.size(words) - window + 1)
    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(pairs: Column) -> Column:
        def twice(p: Column, i: Column) -> Column:
            same = lambda j: F.coalesce(F.get(pairs, j)["h"] == p["h"], F.lit(False))
            return same(i - 1) | same(i + 1)

        places = F.array_sort(F.transform(F.filter(pairs, twice), lambda p: p["i"]))
        gaps = let(places, lambda ps: F.transform(ps, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(ps, i + 1) - p, F.lit(window)))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def count(hs: Column) -> Column:
        pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(let(pairs, covered))

    return F.when(F.size(words) <= window, 0).otherwise(let(hashes, count)).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of `text`; a null text has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = let(_words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words")))
    lines = let(_lines(text), lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    return docs.withColumns({
        "w": counted, "l": lines,
        "word_chars": F.length(F.regexp_replace(text, _GAP, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long"),
    }).select(*docs.columns, "w.*", "l.*", "word_chars", "n_symbols")


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Times that a sample is gone through to measure costs, so that they stand out from what a job costs by itself.
REPEATS = 24


def order_rules(sample: DataFrame, given: Sequence[Rule]) -> list[Rule]:
    """The rules by rejections per second on `sample`, a written table that has the base counts; by name if there is no sample.

    Each rule runs over REPEATS copies of the sample, three times.  Its cost is the median beyond that of no rule, rounded to
    powers of two, at least an eighth of the dearest rule's: below that, times tell noise.
    """
    n = max(1, sample.count())
    sample = sample.crossJoin(F.broadcast(sample.sparkSession.range(REPEATS).withColumnRenamed("id", "copy")))

    def seconds(condition: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hits = sample.agg(F.count_if(condition)).first()[0]
        return time.perf_counter() - began, hits

    measured = lambda condition: sorted(seconds(condition) for _ in range(3))[1]
    empty = min(measured(F.lit(False))[0], measured(F.lit(False))[0])
    runs = [(rule, *measured(F.coalesce(rule.rejects, F.lit(False)))) for rule in given]
    dearest = max((t - empty for _, t, _ in runs), default=0)
    cost = lambda t: 2.0 ** round(math.log2(max(t - empty, dearest / 8, 1e-3)))
    return [rule for rule, *_ in sorted(runs, key=lambda x: (-(x[2] / REPEATS / n + 1e-6) / cost(x[1]), x[0].name))]


def quality(docs: DataFrame, id_col: str, text_col: str, given: Sequence[Rule] | None = None, sample_rows: int = 256, sample_chars: int = 20_000) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, failed_rule, kept.

    `base_failed`: under 20 words, or over 30 % of them in 8-word windows found twice or more.
    Other texts pass the cascade: rules are tried in the order of rejections per cost, which
    are measured on a bounded sample (the first `sample_rows` texts of at most `sample_chars`
    characters), and a text leaves at its first rejection (CASE branches are lazy), so costly
    rules see few texts.  The order changes the cost and which of several failing rules is
    named, never `kept`.

    Null and blank texts have no words and fail the base.  Rows are independent, so ties,
    repeated and null ids are carried as they are; extra columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    mine = own_names(docs, id=id_col, text=text_col)
    texts = [r.text for r in mine.where(F.length("text") <= sample_chars).select("text").head(sample_rows)]
    chosen = list(given or rules())
    if texts:
        # the cascade sees only texts that pass the base, so costs and rejections are those of such texts
        sample = base_counts(spark.createDataFrame([(t,) for t in texts], "text string")).where(~_base_failed())
        chosen = order_rules(table(sample, "sample"), chosen)
    base = base_counts(mine).withColumn("base_failed", _base_failed())
    verdict = functools.reduce(lambda case, rule: case.when(rule.rejects, F.lit(rule.name)), chosen, F.when(F.col("base_failed"), F.lit("base")))
    counts = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    return base.select("id", *counts, "base_failed", verdict.alias("failed_rule")).withColumn("kept", F.col("failed_rule").isNull())
