"""Operator 2: document fingerprints from closed syncmers [DataFrame functions only].

A k-mer is a run of K words, the first ones of a text with empty words before them, so that a text of any length has one
for each word. It is a closed syncmer if, among the runs of S words inside it, the one with the least hash is the first or
the last. Whether a k-mer is chosen depends on its own words alone, so that equal passages give equal anchors wherever they
stand. A word of more than LONG characters counts as that many words of one, for texts that do without white space. A
fingerprint is the SKETCH least hashes of the anchors. The likeness of two is the share of the least SKETCH hashes of either
that both have, an estimate of the Jaccard similarity of the anchors; it is exact where both texts have no more anchors than
that.

The next document is found without a global sort in one task: quantiles of doc_id bound the buckets, a copy of the first
row of each bucket also goes to the bucket before, and a window runs within the bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, table

K, S = 5, 2
LONG = 24
SKETCH = 64
#: Buckets of doc_id for each shuffle partition.
BUCKETS_EACH = 4


def _shift(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0)))


def _head(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))


def with_syncmers(df: DataFrame, tokens: Column, out: str) -> DataFrame:
    """df with a column of one hash or null for each token, in their order: null where the k-mer that ends with it is no
    closed syncmer. Each step is a column of its own, so that none is computed twice."""
    t, h, s, m, w = (f"_{out}_{x}" for x in "thsmw")
    c = F.col
    df = df.withColumn(t, tokens).withColumn(h, F.transform(F.concat(F.array_repeat(F.lit(""), K - 1), c(t)), lambda x: F.xxhash64(x)))
    df = df.withColumn(s, F.zip_with(_head(c(h), 1), _shift(c(h), 1), lambda a, b: F.xxhash64(a, b)))  # S = 2 words
    df = df.withColumn(m, F.zip_with(_head(c(s), 1), _shift(c(s), 1), lambda a, b: F.least(a, b)))
    df = df.withColumn(w, F.zip_with(_head(c(m), 2), _shift(c(m), 2), lambda a, b: F.least(a, b)))  # of the K - S + 1 = 4 runs within
    chosen = F.transform(c(w), lambda x, i: F.when((F.get(c(s), i) == x) | (F.get(c(s), i + K - S) == x), F.xxhash64(F.get(c(s), i), F.get(c(s), i + 2), F.get(c(s), i + 3))))
    return df.withColumn(out, chosen).drop(t, h, s, m, w)


def words(text: Column) -> Column:
    found = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    cut = F.flatten(F.transform(found, lambda x: F.when(F.length(x) > LONG, F.filter(F.split(x, ""), lambda y: y != "")).otherwise(F.array(x))))
    return F.when(text.rlike(rf"[^\x20\x09-\x0D]{{{LONG + 1}}}"), cut).otherwise(found)


def _sketch(hashes: Column) -> Column:
    found = F.transform(F.array_compact(hashes), lambda x: F.shiftrightunsigned(x, 32))
    return F.slice(F.sort_array(F.array_distinct(found)), 1, SKETCH)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the least SKETCH anchor hashes of the text column, as sorted 32-bit numbers; none for a text without words."""
    a = f"_{out}_anchors"
    return with_syncmers(df, words(F.col(text)), a).withColumn(out, _sketch(F.col(a))).drop(a)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1. Two empty fingerprints are alike, an empty and another are not."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect(a, b), least))
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(least), F.lit(1)))


def printed(fingerprint: Column) -> Column:
    """The hashes, in hexadecimal."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, position (of the first word, from 0), hash: every closed syncmer of K words of each whole text, for
    positional matching. Null texts and those of fewer words have none."""
    x = with_syncmers(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), words(F.col("text")), "hashes")
    x = x.select("doc_id", F.posexplode("hashes").alias("position", "hash")).withColumn("position", F.col("position") - (K - 1))
    return x.filter(F.col("hash").isNotNull() & (F.col("position") >= 0))


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below doc_id; bounds are looked up in two steps of about a square root of them."""
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not parts:
        return F.lit(0)
    below = lambda values: F.size(F.filter(values, lambda b: b <= doc_id))
    firsts = F.array(*[F.lit(p[0]).cast("long") for p in parts])
    nested = F.array(*[F.array(*[F.lit(b).cast("long") for b in p]) for p in parts])
    top = below(firsts)
    return F.when(top == 0, F.lit(0)).otherwise((top - 1) * step + below(F.element_at(nested, F.greatest(top, F.lit(1)))))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, _bucket, _order, _hash: docs dealt into buckets, with a copy (_order 1) of the next bucket's first row.

    The order is descending doc_id, rows that repeat a doc_id by a hash of their text. Rows with a null doc_id (_order 2)
    stand outside of it."""
    spark = docs.sparkSession
    n = BUCKETS_EACH * shuffle_partitions(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    fractions = [i / n for i in range(1, n)]
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", fractions, 10 * n).alias("b")).first()["b"] or []))  # fewer than n numbers
    firsts = ids.filter("doc_id is not null").withColumn("bucket", _bucket(F.col("doc_id"), bounds)).groupBy("bucket").agg(F.max("doc_id").alias("first_id"))
    order, everything = Window.orderBy("bucket"), Window.partitionBy()  # a row for each bucket
    firsts = firsts.select("first_id", F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(everything)).alias("_copy"))
    firsts = materialize(firsts, "firsts")  # n rows at most, so a broadcast is safe
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    x = x.join(F.broadcast(firsts), F.col("doc_id") == F.col("first_id"), "left").drop("first_id")
    own = F.struct(
        F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(n))).otherwise(_bucket(F.col("doc_id"), bounds)).cast("int").alias("b"),
        F.when(F.col("doc_id").isNull(), 2).otherwise(0).alias("o"),
    )
    copy = F.when(F.col("_copy").isNotNull(), F.struct(F.col("_copy").cast("int").alias("b"), F.lit(1).alias("o")))
    x = x.withColumn("_at", F.explode(F.array_compact(F.array(own, copy))))
    return x.select("doc_id", "text", F.col("_at.b").alias("_bucket"), F.col("_at.o").alias("_order"), F.xxhash64("text").alias("_hash"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs
    (doc_id, text).

    A null text is empty. Of a single document the next is itself. A row with a null doc_id has no place in the order:
    its edited text only loses its last third and near_next is null. Rows that repeat are each other's next. An empty table gives no
    rows. Other columns are ignored."""
    c = F.col
    order = Window.partitionBy("_bucket").orderBy("_order", c("doc_id").desc(), "_hash")
    x = with_next(docs).withColumn("_next", F.lead("text").over(order))
    placed = c("_order") != 2
    n = F.length("text").cast("long")
    cut = F.floor(n / 3).cast("int")
    x = x.withColumn("n_chars", n).withColumn("_edited", F.concat(F.substring(c("text"), F.lit(1), (n - cut).cast("int")), F.when(placed, F.substring(F.coalesce("_next", F.lit("")), F.lit(1), cut)).otherwise("")))
    x = x.drop("_next")
    x = with_fingerprint(x, "text", "_own").drop("text")
    x = x.withColumn("edited_sha256", F.sha2(c("_edited").cast("binary"), 256))
    x = with_fingerprint(x, "_edited", "_other").drop("_edited")
    x = x.withColumn("_next", F.lead("_own").over(order)).filter("_order <> 1")
    return x.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(c("_own")).alias("fingerprint"),
        printed(c("_other")).alias("edited_fingerprint"),
        likeness(c("_own"), c("_other")).alias("near_edited"),
        F.when(placed, likeness(c("_own"), c("_next"))).alias("near_next"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
