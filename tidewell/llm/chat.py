"""Preference pairs of conversations: one shared prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, own_names, table

#: A turn as text: header, content, end mark.
HEAD, TAIL = ("<|", "|>\n"), "<|end|>\n"
TURN = "struct<role:string,text:string>"


def conversations(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turns) with each conversation's turns in order, as the unit of training it is.

    Turns are ordered by number, then role and text, so ties are settled; equal rows count
    once; a null number comes first; null roles and texts are empty.  A conversation's turns
    are one row of the result however they are computed, so their array is bounded by the
    longest example, not by the table.
    """
    given = own_names(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_set(one))
    return given.groupBy("conv").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(turns: Column) -> Column:
    """The text of some turns."""
    return F.array_join(F.transform(turns, _turn), "")


def _turn(t: Column) -> Column:
    return F.concat(F.lit(HEAD[0]), t["role"], F.lit(HEAD[1]), t["text"], F.lit(TAIL))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in role and text."""
    differ = F.filter(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p, i: F.when(~p["a"].eqNullSafe(p["b"]), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(differ, F.lit(0)), F.greatest(F.size(a), F.size(b)))


def masked(turns: Column, trained: str) -> Column:
    """Spans [from, to) in code points of the rendered turns that carry loss: content and end mark of `trained` turns."""

    def step(held: Column, t: Column) -> Column:
        start = held["at"] + len(HEAD[0]) + len(HEAD[1]) + F.length(t["role"])
        end = start + F.length(t["text"]) + len(TAIL)
        span = F.struct(start.cast("int").alias("from"), end.cast("int").alias("to"))
        return F.struct(end.cast("int").alias("at"), F.when(t["role"] == trained, F.array_append(held["spans"], span)).otherwise(held["spans"]).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))
    return F.aggregate(turns, empty, step, lambda held: held["spans"])


def format_preferences(pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """`pairs` (any keys, chosen, rejected: arrays of TURN) with n_common, prompt and both completions.

    The longest common turn prefix is rendered once as `prompt`; what differs are the
    completions `chosen_text` and `rejected_text`, with `chosen_mask` and `rejected_mask` the
    spans that carry loss.  If one conversation is the start of the other, its completion is
    empty.  Pairs of equal conversations (`n_common` all turns) express no preference and are
    left out, as are pairs with a null side.  Other columns are carried.
    """
    given = pairs.where("chosen is not null and rejected is not null").withColumn("n_common", common_prefix(F.col("chosen"), F.col("rejected")))
    given = given.where((F.col("n_common") < F.size("chosen")) | (F.col("n_common") < F.size("rejected")))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    out = given.withColumn("prompt", render(F.slice("chosen", 1, F.col("n_common"))))
    for side in ("chosen", "rejected"):
        out = out.withColumn(f"{side}_text", render(rest(F.col(side)))).withColumn(f"{side}_mask", masked(rest(F.col(side)), trained))
    return out.drop("chosen", "rejected")


def echoed(convs: DataFrame, which: Column, trained: str = "assistant") -> DataFrame:
    """(conv, chosen, rejected) of conversations with an answer, cut after the last one.

    The rejected side is made: answer number `which` (0 is the first; taken modulo their number) only repeats
    the turn before it, or is empty if there is none, and the rest of the conversation goes on as it was.
    """
    answers = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == trained, i)), lambda i: i.isNotNull())
    given = convs.withColumn("answers", answers).where(F.size("answers") > 0)
    given = given.withColumn("at", F.get("answers", F.pmod(which, F.size("answers")).cast("int"))).withColumn("chosen", F.slice("turns", 1, F.try_element_at("answers", F.lit(-1)) + 1))
    asked = F.coalesce(F.get("turns", F.col("at") - 1)["text"], F.lit(""))
    echo = F.struct(F.lit(trained).alias("role"), asked.alias("text"))
    return given.select("conv", "chosen", F.transform("chosen", lambda t, i: F.when(i == F.col("at"), echo).otherwise(t)).alias("rejected"))


def siblings(convs: DataFrame) -> DataFrame:
    """(conv, other, chosen, rejected) of conversations whose first turn others share, too.

    The one of least id stands as chosen for all of its opening, and each other one (`conv`) is rejected against
    it (`other`), so an opening that a third of all conversations share makes as many pairs as it has members.
    Openings are counted by combining on the map side; the join on them leaves a common one for the
    adaptive execution to split.
    """
    opened = convs.withColumn("opening", F.get("turns", F.lit(0)))
    shared = opened.groupBy(F.col("opening.role").alias("r"), F.col("opening.text").alias("x")).agg(F.count("*").alias("c"), F.min("conv").alias("first")).where("c > 1").drop("c")
    lead = shared.join(convs.select(F.col("conv").alias("other"), F.col("turns").alias("chosen")), F.col("first") == F.col("other")).drop("first")
    joined = opened.join(lead, (F.col("opening.role") == F.col("r")) & (F.col("opening.text") == F.col("x")))
    return joined.where(~F.col("conv").eqNullSafe(F.col("other"))).select("conv", "other", "chosen", F.col("turns").alias("rejected"))


def preferences(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Formatted pairs of all conversations of a table of turns: conv, kind, other and the columns of `format_preferences`.

    Kinds: `sibling` for pairs of conversations with one opening (see `siblings`), `echo` for a conversation
    and its variant with an echoed answer (see `echoed`; which one goes by the number of the conversation), and `none` for a
    conversation without an answer, or whose answer is its echo: all of it is the prompt, and its completions are empty.
    So every conversation has one row of `echo` or `none`.  Null ids are one conversation; an empty table gives no rows.
    """
    convs = table(conversations(turns, conv_col, turn_col, role_col, text_col), "conversations")
    other = F.lit(None).cast(convs.schema["conv"].dataType)
    which = F.coalesce(F.col("conv").try_cast("long"), F.lit(0))
    echo = format_preferences(echoed(convs, which))
    pairs = echo.select("conv", F.lit("echo").alias("kind"), other.alias("other"), *echo.columns[1:])
    pairs = pairs.unionByName(format_preferences(siblings(convs)).withColumn("kind", F.lit("sibling")))
    left = convs.join(echo.select(F.col("conv").alias("done")), F.col("conv").eqNullSafe(F.col("done")), "left_anti")
    spans = F.array().cast("array<struct<from:int,to:int>>")
    none = left.select("conv", F.lit("none").alias("kind"), other.alias("other"), F.size("turns").alias("n_common"), render(F.col("turns")).alias("prompt"), F.lit("").alias("chosen_text"), spans.alias("chosen_mask"), F.lit("").alias("rejected_text"), spans.alias("rejected_mask"))
    return pairs.unionByName(none)


def spans_text(spans: Column) -> Column:
    """Spans as text: from-to, comma-joined."""
    return let(spans, lambda s: F.array_join(F.transform(s, lambda x: F.concat(x["from"], F.lit("-"), x["to"])), ","))
