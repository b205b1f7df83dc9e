"""Cleaning, sentences and keys, on literal cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as t


def apply(spark, fn, value):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


def clean(spark, value):
    return t.normalise_documents(spark.createDataFrame([(value,)], "text string")).first().text


LONG = "The company recognises revenue when control of goods passes to the customer in full"


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("the Company’s “plan”", "the Company's \"plan\""),
        ("non‑GAAP", "non-GAAP"),
        ("clean\x00te​xt", "cleantext"),
        ("informa-\ntion security", "information security"),
        ("Real content here\n2.1 Events and Incidents ................ 6\nMore content", "Real content here\nMore content"),
        ("Content\n17\nMore", "Content\nMore"),
        ("a    b\n\n\n   \nc", "a b\nc"),
        ("ﬁne", "fine"),
        ("", ""),
        ("one\r\ntwo\u2028three", "one\ntwo\nthree"),
    ],
)
def test_normalise(spark, raw, wanted):
    assert clean(spark, raw) == wanted


def test_hyphen_before_capital_stays(spark):
    assert "Well-" in clean(spark, "Well-\nKnown Sources")


def test_running_footer_goes_and_prose_stays(spark):
    footer = "\n".join(f"{LONG} number {i}.\nApple Inc. | 2025 Form 10-K | {10 + i}" for i in range(6))
    assert "Form 10-K |" not in clean(spark, footer)
    years = "\n".join(f"{LONG} in fiscal year {2019 + i}." for i in range(6))
    assert len(clean(spark, years).split("\n")) == 6
    none = "\n".join(f"Item {c}\nNone." for c in "ABCDEF")
    assert clean(spark, none).split("\n").count("None.") == 6
    repeated = "\n".join([LONG + " and so on and so forth."] * 6)
    assert len(clean(spark, repeated).split("\n")) == 6
    rows = "\n".join(["| Total net sales | $416,161 | $391,035 |"] * 6)
    assert clean(spark, rows) == rows


def test_null_stays_null(spark):
    assert clean(spark, None) is None


def test_sentences_and_tokens(spark):
    assert apply(spark, t.sentences, 'He said "Stop." Then 5 more! yes. ok') == ['He said "Stop."', "Then 5 more! yes. ok"]
    assert apply(spark, t.sentences, "One is here. Two is there.") == ["One is here.", "Two is there."]
    assert apply(spark, t.token_count, "") == 1
    assert apply(spark, t.token_count, "a b c") == int(3 * 1.6) + 1
    assert apply(spark, t.search_tokens, "Don't STOP-me 42") == ["don", "t", "stop", "me", "42"]
    assert apply(spark, t.content_key, "é") == hashlib.sha256("é".encode()).hexdigest()
    assert apply(spark, t.snippet, "a\nb") == "a b"


def test_frequent_tells_places(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c", "a", "b", None, None, None],)], "x array<string>")
    places = lambda n: sorted(df.select(t.frequent(F.col("x"), n).alias("y")).first().y)
    assert places(3) == [0, 2, 4] and places(2) == [0, 1, 2, 4, 5] and places(1) == [0, 1, 2, 3, 4, 5] and places(4) == []
