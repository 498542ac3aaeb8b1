import random

from pyspark.sql import functions as F

from tidewell.llm import chat, queries

TURNS = "conv_id bigint, turn bigint, role string, text string, conv string, chosen int"


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def pairs(spark, *rows):
    return spark.createDataFrame(rows, f"k int, chosen array<{chat.TURN}>, rejected array<{chat.TURN}>")


def test_longest_common_prefix_and_masks(spark):
    rng = random.Random(1)
    rows = []
    for k in range(60):
        common = [(rng.choice(["user", "assistant", "system"]), rng.choice("ab") * rng.randrange(4)) for _ in range(rng.randrange(4))]
        rows.append((k, *(common + [(rng.choice(["user", "assistant"]), rng.choice(["x", "yé", ""])) for _ in range(rng.randrange(3))] for _ in range(2))))
    found = {r.k: r for r in chat.format_preferences(pairs(spark, *rows)).collect()}
    for k, a, b in rows:
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        if a == b:
            assert k not in found
            continue
        r = found[k]
        assert (r.n_common, r.prompt) == (n, render(a[:n]))
        assert r.prompt + r.chosen_text == render(a) and r.prompt + r.rejected_text == render(b)
        for text, mask, turns in ((r.chosen_text, r.chosen_mask, a[n:]), (r.rejected_text, r.rejected_mask, b[n:])):
            assert [text[s["from"] : s["to"]] for s in mask] == [t + "<|end|>\n" for role, t in turns if role == "assistant"]


def test_null_sides_are_left_out(spark):
    assert chat.format_preferences(pairs(spark, (1, None, [("user", "x")]), (2, [("user", "x")], None))).collect() == []


def test_conversations_with_ties_and_nulls(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, None, None), (2, 1, "assistant", "z"), (None, 0, "user", "q"), (None, 1, "assistant", None), (3, None, "user", "first"), (3, 0, "assistant", "then"), (4, 0, "assistant", "alone")]
    found = {r.conv: [tuple(t) for t in r.turns] for r in chat.conversations(spark.createDataFrame([(*r, "c", 1) for r in rows], TURNS), "conv_id", "turn", "role", "text").collect()}
    assert found == {1: [("user", "a"), ("assistant", "b")], 2: [("", ""), ("assistant", "z")], None: [("user", "q"), ("assistant", "")], 3: [("user", "first"), ("assistant", "then")], 4: [("assistant", "alone")]}
    made = {r.conv: r for r in chat.preferences(spark.createDataFrame([(*r, "c", 1) for r in rows], TURNS), "conv_id", "turn", "role", "text").collect()}
    assert made[1].rejected_text == "<|assistant|>\na<|end|>\n" and made[4].prompt == ""
    assert {k: r.kind for k, r in made.items()} == {1: "echo", 2: "echo", None: "echo", 3: "echo", 4: "echo"}


def test_siblings_share_an_opening_and_everyone_has_a_row(spark):
    """Real pairs: conversations with one first turn, against the one of least id; a very common opening makes a row for each."""
    rows = [(i, 0, "user", "hi") for i in range(300)] + [(i, 1, "assistant", f"answer {i % 3}") for i in range(300)] + [(i, 2, "user", f"more {i}") for i in range(300)]
    rows += [(900, 0, "user", "alone"), (901, 0, "user", "hi"), (902, 0, "user", "x"), (902, 1, "assistant", "x"), (903, 0, "user", "long " * 50_000), (903, 1, "assistant", "y")]
    found = chat.preferences(spark.createDataFrame([(*r, "c", 1) for r in rows], TURNS), "conv_id", "turn", "role", "text").collect()
    siblings = {r.conv: r for r in found if r.kind == "sibling"}
    assert set(siblings) == {*range(1, 300), 901} and all(r.other == 0 for r in siblings.values())
    for i in range(1, 300):
        assert siblings[i].n_common == (2 if i % 3 == 0 else 1)
    assert siblings[901].n_common == 1 and siblings[901].rejected_text == ""
    once = [r for r in found if r.kind != "sibling"]
    assert sorted(r.conv for r in once) == [*range(300), 900, 901, 902, 903] and {r.conv for r in once if r.kind == "none"} == {900, 901, 902}
    assert chat.preferences(spark.createDataFrame([], TURNS), "conv_id", "turn", "role", "text").collect() == []


def test_no_python_on_executors(spark, sf):
    plan = queries.QUERIES["op7_preference_pairs"](spark, sf)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_equals_sql(agree):
    agree(queries.QUERIES["op7_preference_pairs"], queries.ORACLES["op7_preference_pairs"])
