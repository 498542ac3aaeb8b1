import hashlib

import pytest
from pyspark.sql import functions as F

from tidewell.functions import keys
from tidewell.functions import text as tx


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"]).select(column).first()[0]


def test_stable_id_hashes_nul_ended_parts(spark):
    want = "item_" + hashlib.sha256("src_1\0talks/é.wav\0".encode()).hexdigest()[:16]
    assert one(spark, keys.item_id("a", "b"), a="src_1", b="talks/é.wav") == want


def test_approval_digest_with_and_without_sidecar(spark):
    rows = spark.createDataFrame([("aa", "bb"), ("aa", None)], "m string, s string").select(keys.approval_digest("m", "s")).collect()
    assert rows[0][0] == hashlib.sha256(b"media\0aa\0transcript-sidecar\0bb").hexdigest()
    assert rows[1][0] == hashlib.sha256(b"media\0aa\0transcript-sidecar-absent").hexdigest()


@pytest.mark.parametrize(("name", "want"), [("My Talk (1)", "my-talk-1"), ("--", "bundle"), ("Éa_b", "éa-b"), ("", "bundle")])
def test_slug(spark, name, want):
    assert one(spark, keys.slug("a"), a=name) == want


def test_bundle_id(spark):
    want = "a-b-" + hashlib.sha256(b"d\0t\0").hexdigest()[:12]
    assert one(spark, keys.bundle_id("a", F.lit("d"), F.lit("t")), a="A b") == want


@pytest.mark.parametrize(("seconds", "want"), [(0.0, "00:00"), (-5.0, "00:00"), (59.9, "00:59"), (3599.0, "59:59"), (3600.0, "01:00:00"), (400000.5, "111:06:40")])
def test_anchor(spark, seconds, want):
    assert one(spark, tx.anchor("a"), a=seconds) == want


@pytest.mark.parametrize("text", ["a  b\tc", " a ", "", "   ", "x\x1cy\x85z w", "a b c"])
def test_white_space_is_pythons(spark, text):
    got = spark.createDataFrame([(text,)], ["a"]).select(tx.collapse("a"), tx.word_count("a"), tx.strip("a")).first()
    assert tuple(got) == (" ".join(text.split()), len(text.split()), text.strip())


@pytest.mark.parametrize(("text", "want"), [("One two. Three.", "One two."), ("No stop", "No stop."), ("Wait... what. Yes", "Wait."), ("End...", "End."), ("Is it? Yes. No", "Is it? Yes.")])
def test_lead_sentence(spark, text, want):
    assert one(spark, tx.lead_sentence("a"), a=text) == want


@pytest.mark.parametrize(("name", "side", "suffix"), [("a.wav", "a.transcript.txt", ".wav"), ("d/a.b.WAV", "d/a.b.transcript.txt", ".wav"), ("d.x/a", "d.x/a.transcript.txt", ""), (".hid", ".hid.transcript.txt", "")])
def test_sidecar_name_and_suffix(spark, name, side, suffix):
    got = spark.createDataFrame([(name,)], ["a"]).select(tx.sidecar_name("a"), tx.suffix("a")).first()
    assert tuple(got) == (side, suffix)


def test_title(spark):
    assert one(spark, tx.title("a"), a="my_first_talk.wav") == "My First Talk"


def test_remote(spark):
    rows = spark.createDataFrame([(" HTTPS://x ",), ("http://y",), ("ftp://z",), ("httpx",)], ["a"]).select(tx.is_remote("a")).collect()
    assert [r[0] for r in rows] == [True, True, False, False]
    assert one(spark, tx.command_is_remote(F.array(F.lit("run"), F.lit(" http://a"))))


@pytest.mark.parametrize("text", ["a\nb", "a\n", "\n", "", "a\r\nb\rc", "x\x0by\x85z "])
def test_lines_are_pythons(spark, text):
    assert one(spark, tx.lines("a"), a=text) == text.splitlines()


@pytest.mark.parametrize(("a", "b", "want"), [("a b c d", "a b c d", 1.0), ("a b c d", "a x c", 0.5), ("", "", 1.0), ("", "a", 0.0), ("a", "b c d", 0.0), ("a b", "", 0.0)])
def test_word_accuracy(spark, a, b, want):
    assert one(spark, tx.word_accuracy("a", "b"), a=a, b=b) == want
