"""Telephone numbers without a plus sign."""

import random

from pyspark.sql import functions as F

from tempora.llm import pii


def test_national_writings_are_found(spark):
    numbers = ["212-555-0147", "212.555.0147", "212 555 0147", "(212) 555-0147", "020 7946 0958", "030 1234567", "(030) 1234567", "01 23 45 67 89"]
    others = ["2024-01-15", "100 200 3000", "01.02.2024", "0.123456789", "212-555.0147", "1 212-555-0147-9", "555-0147"]
    texts = [f"Please call {n} before noon" for n in numbers] + [f"It holds {n} in all" for n in others]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    for i, n in enumerate(numbers):
        at = texts[i].index(n)
        assert got[i] == f"phone:{at}:{at + len(n)}", n
    assert [got[i] for i in range(len(numbers), len(texts))] == [""] * len(others)


def test_masks_against_a_plain_loop(spark):
    rnd = random.Random(3)
    data = []
    for i in range(60):
        text = "".join(rnd.choice("ab1 .@é漢😀\n") for _ in range(rnd.choice([0, 1, 255, 256, 257, 700])))
        starts = [rnd.randrange(len(text)) for _ in range(rnd.choice([0, 1, 5, 150]))] if text else []
        data.append((i, text, [(s, min(len(text), s + rnd.choice([1, 3, 40]))) for s in starts]))
    df = spark.createDataFrame(data, "i int, text string, spans array<struct<s: int, e: int>>")
    got = {r.i: r.m for r in df.select("i", pii.masked(F.col("text"), F.col("spans")).alias("m")).collect()}
    for i, text, spans in data:
        hidden = {p for s, e in spans for p in range(s, e)}
        assert got[i] == "".join("*" if p in hidden else c for p, c in enumerate(text)), i


def test_masking_many_spans_costs_near_linear_time(spark):
    text = "12 x 1.2.3.4 a@b.c " * 30_000
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert pii.redact(df, pii.Model([], {})).first().text == "12 x ******* ***** " * 30_000
