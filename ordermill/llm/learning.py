"""Bounded training samples for the toxicity classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: A classifier learns from at most so many labelled documents, whole ones, of at most so many code points together.
SAMPLE, SAMPLE_CHARS = 8000, 64_000_000


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, learnable, rows: int = SAMPLE) -> DataFrame:
    """doc_id, h, y, lang, text of the `rows` labelled documents with the least hashes h of doc_id.

    The bound is on rows of labels, before any text is read: their ids are broadcast. Rows with null labels or ids are
    left out; of rows that repeat a doc_id one text, the least, is taken. lang is for grouping the training rows and is no
    input of a score."""
    ids = labels.filter(learnable & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label)).cast("int").alias("y"))
    ids = ids.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("h").alias("h"), F.min("y").alias("y"), F.min(F.struct("text", "lang")).alias("t")).select("doc_id", "h", "y", "t.lang", "t.text")


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, learnable, rows: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """The labelled_rows, in the order of h, as far as all texts up to there have `chars` code points."""
    found = materialize(labelled_rows(docs, labels, label, learnable, rows), "sample")
    upto = F.sum("n").over(Window.orderBy("h", "doc_id"))  # `rows` rows at most
    fit = found.select("doc_id", "h", F.length("text").alias("n")).select("doc_id", upto.alias("upto")).filter(F.col("upto") <= chars).select("doc_id")
    return found.join(F.broadcast(fit), "doc_id", "left_semi")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable, rows: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[tuple[str, int, str | None]]:
    """(text, label, lang) of sample_rows in the order of h."""
    some = sample_rows(docs, labels, label, learnable, rows, chars)
    return [(r["text"], r["y"], r["lang"]) for r in sorted(some.collect(), key=lambda r: (r["h"], r["doc_id"]))]
