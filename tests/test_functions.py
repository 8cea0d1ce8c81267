"""Rules for texts, codes and the clock, by hand-written cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ordermill.functions import codes
from ordermill.functions import text as T
from ordermill.functions.clock import Clock


def one(spark, column, *values, types="string"):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, [types] * len(values) if isinstance(types, str) else types, strict=True))
    return spark.createDataFrame([values], schema).select(column(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize("paper, grammage, width, supplier, code", [("kraft blanchi", 100, 28, "mondi", "KB100L28MON"), (None, None, None, None, "KE80"), ("Kraft très blanchi", 90, None, "x", "KE90"), ("ECRU", 0, 0, "Smurfit SA", "KE80SMU")])
def test_article_code(spark, paper, grammage, width, supplier, code):
    assert one(spark, codes.article_code, paper, grammage, width, supplier, types=("string", "long", "long", "string")) == code


@pytest.mark.parametrize("code, parts", [("KB100L28MON", ("Kraft Blanchi", 100, 28, "Mondi")), ("KE80", ("Kraft Écru", 80, None, None)), ("L30XYZ", (None, None, 30, "XYZ")), ("", (None, None, None, None)), (None, (None, None, None, None))])
def test_parsed_code(spark, code, parts):
    assert tuple(one(spark, codes.parsed_code, code)) == parts


@pytest.mark.parametrize("text, code", [("sachets kraft blanchi 80g laize 25", "KB80L25"), ("kraft ecru grammage: 120 l30 nordic", "KE120L30NOR"), ("sac", "KE80"), ("", None), (None, None)])
def test_suggested_code(spark, text, code):
    assert one(spark, codes.suggested_code, text) == code


def test_standard_codes(spark):
    x = codes.standard_codes(spark)
    assert x.count() == 648 and x.select("code").distinct().count() == 216


@pytest.mark.parametrize("name, norm", [("Société Café", "societe cafe"), ("Société M'hamid-Café", "societe mhamid cafe"), ("Company 123 Inc.", "company 123 inc"), ("", ""), (None, ""), ("Ünal Ça", "unal ca")])
def test_normalized_name(spark, name, norm):
    assert one(spark, T.normalized_name, name) == norm


@pytest.mark.parametrize("body, n, kind, got", [("", 1, "IMAGE/png", "image"), ("hi", 1, "video/mpeg", "audio"), (None, 1, "application/pdf", "document"), (None, 1, None, "file"), ("hi", 0, "image/png", "text"), (" ", 0, None, "unknown"), (None, None, None, "unknown")])
def test_media_kind(spark, body, n, kind, got):
    assert one(spark, T.media_kind, body, n, kind, types=("string", "int", "string")) == got


def test_phones(spark):
    assert one(spark, T.international, "whatsapp:+212 6 12") == "+212612"
    assert [one(spark, T.channel_address, x) for x in ("212", "+212", "whatsapp:+212")] == ["whatsapp:+212"] * 3
    assert one(spark, T.phone_in, "Client +212612 x") == "+212612" and one(spark, T.phone_in, "none") is None
    assert one(spark, T.phone_tail, "Client +2126 x") == "+2126 x"


def test_fallbacks(spark):
    assert one(spark, T.filled, "", "b") == "b" and one(spark, T.filled, None, "b") == "b" and one(spark, T.filled, "a", "b") == "a"
    assert [one(spark, T.client_code, n, types="long") for n in (7, 12345, 1234567)] == ["CL00007", "CL12345", "CL1234567"]
    assert one(spark, T.resolved_source, None, "Msg WhatsApp 3") == "whatsapp" and one(spark, T.resolved_source, "", None) == "email"
    assert one(spark, T.shortened, "x" * 21) == "x" * 20 + "..." and one(spark, T.shortened, "x" * 20) == "x" * 20


def test_small_texts(spark):
    assert [one(spark, T.human_size, n, types="long") for n in (0, 1023, 1024, 5 << 20, 3 << 40)] == ["0.0 B", "1023.0 B", "1.0 KB", "5.0 MB", "3.0 TB"]
    assert one(spark, T.time_ago, 7200, types="long") == "Il y a 2h"
    assert one(spark, T.model_json, '```json\n{"a": 1}\n```') == '{"a": 1}' and one(spark, T.model_json, ' {"a": 1}') == '{"a": 1}'
    assert one(spark, T.asks_again, "On veut COMME D'HABITUDE svp") is True and one(spark, T.asks_again, None) is False
    assert [one(spark, T.file_kind, x) for x in ("a.PDF", "b.tar.jpg", "c.csv", "d", None)] == ["pdf", "image", "text", "other", "other"]
    assert one(spark, T.generic_name, "Client WhatsApp 3") is True and one(spark, T.generic_name, None) is False
    assert one(spark, T.audio_extension, "audio/mp4; x") == "m4a" and one(spark, T.audio_extension, None) == "ogg"


def test_clock(spark):
    clock = Clock("2001-08-01 06:00:00")
    got = spark.range(1).select(clock.days_ago(7).cast("string").alias("a"), clock.exactly_days_ago(7).cast("string").alias("b"), clock.month_start().cast("string").alias("c"), clock.hours_since(F.lit("2001-07-31 05:00:00").cast("timestamp_ntz")).alias("d")).first()
    assert tuple(got) == ("2001-07-25", "2001-07-25 06:00:00", "2001-08-01", 25.0)
