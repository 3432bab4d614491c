"""Masking a table of secrets against the fold over all of them."""

import random

import pytest

from attest.functions.text import MASK, redact
from attest.operators import secrets as module
from attest.operators.secrets import found_secrets, redact_table


def fold(text, secrets):
    for secret in sorted({s for s in secrets if s and len(s) > 3 and text is not None and s in text}, key=lambda s: (-len(s), s)):
        text = text.replace(secret, MASK)
    return text


def masked(spark, texts, secrets, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame([(s,) for s in secrets], "secret string")
    out = redact_table(rows, "text", table, patterns=(), **options)
    assert out.columns == ["id", "text", "redacted"]
    return [r["redacted"] for r in out.orderBy("id").collect()]


def test_defined_cases(spark):
    texts = [None, "", "abc", "key=abcd1234;", "abcd1234abcd1234", "two words here", "xtwo wordsy", "two  words", "a\tb two\nwords", "éàüöß", "abcd1234", "abcd1234"]
    secrets = [None, "", "abc", "abcd", "abcd1234", "abcd1234", "two words", "o words h", "two  words", "àüöß", "\tb two\n"]
    assert masked(spark, texts, secrets) == [fold(t, secrets) for t in texts]


@pytest.mark.parametrize("part", [1, 7, 512])
def test_as_the_fold(spark, monkeypatch, part):
    monkeypatch.setattr(module, "WORD_PART", part)
    draw = random.Random(part)
    texts = ["".join(draw.choice("ab \n") for _ in range(draw.randint(0, 120))) for _ in range(150)]
    secrets = ["".join(draw.choice("ab \n") for _ in range(draw.randint(1, 14))) for _ in range(60)]
    assert masked(spark, texts, secrets) == [fold(t, secrets) for t in texts]


def test_many_secrets_only_one_of_them_there(spark):
    secrets = [f"glpat-{i:06d}" for i in range(20_000)]
    texts = ["x" * 3000 + "glpat-000042" + "y" * 3000, "glpat-999999"] + ["plain words of prose"] * 50
    assert masked(spark, texts, secrets, slice_rows=10) == [fold(t, ["glpat-000042"]) for t in texts]


def test_empty_tables_and_patterns(spark):
    assert masked(spark, ["some text"], []) == ["some text"]
    assert masked(spark, [], ["some"]) == []
    rows = spark.createDataFrame([("Bearer abc and hunter22",)], "text string")
    table = spark.createDataFrame([("hunter22",)], "secret string")
    got = redact_table(rows, "text", table).first()["redacted"]
    assert got == rows.select(redact("text", ["hunter22"]).alias("r")).first()["r"] == f"{MASK} and {MASK}"


def test_plan_looks_up_by_equality(spark):
    rows = spark.range(10).selectExpr("cast(id as string) AS text")
    table = spark.range(10).selectExpr("concat('secret-', id) AS secret")
    plan = found_secrets(rows, "text", table)._jdf.queryExecution().optimizedPlan().toString()
    assert "piece" in plan and "Inner, (piece" in plan


def test_common_second_words_are_not_cut_out(spark):
    """Only runs that begin as a secret does are compared: here one of three thousand."""
    texts = spark.createDataFrame([(str(i), f"word{i} of the things in it") for i in range(3000)] + [("x", "a secret of the things")], "id string, text string")
    known = module.known_secrets(spark.createDataFrame([("secret of the",)], "secret string"))
    assert [r["id"] for r in module._in_runs(texts, known).collect()] == ["x"]


def test_more_secrets_than_bits(spark, monkeypatch):
    monkeypatch.setattr(module, "SLOTS", 1)
    secrets = [f"my key{i} word" for i in range(300)] + ["o w", " lead", "tail "]
    texts = [f"so my key{i} words and tail lead" for i in range(290, 310)] + ["two words"]
    assert masked(spark, texts, secrets) == [fold(t, secrets) for t in texts]
