"""Landed mail and logs: newest rows, unseen rows, schedules, suggestions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.clock import Clock

#: Fields that a repeated order takes over.
SUGGESTED = ("produit_type", "nature_produit", "quantite", "unite")


def newest(rows: DataFrame, n: int, by: str = "id") -> DataFrame:
    """The last n rows, newest first."""
    return rows.orderBy(F.desc(by)).limit(n)


def unseen(mails: DataFrame) -> DataFrame:
    return mails.filter(~F.coalesce("seen", F.lit(False)))


def next_slot(clock: Clock, hours: Column) -> Column:
    """The next full multiple of so many hours of the day, over the end of a day or month as well."""
    done = F.floor(F.hour(clock.now()) / hours) + 1
    at = F.least(done * hours, F.lit(24)).cast("int")
    return (F.date_trunc("DAY", clock.now()) + F.make_dt_interval(hours=at)).cast("timestamp_ntz")


def thousands(value: Column) -> Column:
    """Whole numbers with thousands apart."""
    return F.format_number(value, 0)


def suggest_reorder(requests: DataFrame, typical: DataFrame) -> DataFrame:
    """requests (row, client_id, fields) with empty fields taken from the client's typical order; the source is named
    wherever the client has one."""
    fields, kinds = [f for f in SUGGESTED if f in requests.columns], dict(requests.dtypes)
    old = typical.select("client_id", F.lit(True).alias("_there"), *[(F.col(f) if f in typical.columns else F.lit(None).cast(kinds[f])).alias(f"_{f}") for f in fields])
    x = requests.join(old, "client_id", "left")
    for f in fields:
        blank = F.col(f).isNull() | (F.col(f) == ("" if kinds[f] == "string" else 0))
        x = x.withColumn(f, F.when(blank, F.coalesce(f"_{f}", f)).otherwise(F.col(f)))
    return x.withColumn("suggestion_source", F.when(F.col("_there"), "client_history")).drop("_there", *[f"_{f}" for f in fields])


def auto_code(code: Column, description: Column, paper: Column, grammage: Column, width: Column) -> Column:
    """A given code, else that of the description, else that of the fields."""
    return F.coalesce(F.nullif(code, F.lit("")), codes.suggested_code(description), codes.article_code(paper, grammage, width, F.lit(None).cast("string")))


def sorted_clients(clients: DataFrame, mode: str = "name") -> DataFrame:
    """Clients (nom, order_count, last_order) by name as a reader sorts it, by orders either way, or by the newest order."""
    orders = {"name": [F.collate("nom", "UNICODE_CI")], "orders_desc": [F.desc("order_count")], "orders_asc": [F.asc("order_count")], "recent": [F.desc_nulls_last("last_order")]}
    return clients.orderBy(*orders[mode], "id")


def text_files(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("txt", "csv")) -> DataFrame:
    """path, text of the text attachments of a folder, read whole as UTF-8; a file that is not UTF-8 has an empty text."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").option("recursiveFileLookup", "true").load(folder)
    return x.select("path", F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit("")).alias("text"))


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of the PDF attachments of a folder, pages joined by line ends; a file that cannot be read, or any where no
    reader for PDF is installed, has an empty text."""

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        import io

        def one(content):
            try:
                from pypdf import PdfReader

                return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
            except Exception:  # whatever a broken file or a missing reader raises
                return ""

        return contents.map(one).astype(object)

    x = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)
    return x.select("path", read("content").alias("text"))


def decoded_header(header: Column) -> Column:
    """A mail header without RFC 2047 encodings (first part only, as the domain reads it); needs Python's mail parser."""
    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        from email.header import decode_header

        def one(value):
            if value is None:
                return None
            try:
                text, charset = decode_header(value)[0]
                return text.decode(charset or "utf-8") if isinstance(text, bytes) else text
            except (LookupError, UnicodeDecodeError):
                return value

        return values.map(one, na_action=None).astype(object)

    return decode(header)
