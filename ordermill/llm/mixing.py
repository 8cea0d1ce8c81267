"""Operator 8: mixing sources to target weights by Efraimidis-Spirakis sampling [DataFrame functions only].

Each document draws an exponential key -ln(u) / w, where u comes from a hash of its doc_id and w is its quality weight.
Within a source the documents sorted by key are taken, after whole epochs, up to the source's budget. The prefix sums
are two-level: keys fall into ordered buckets of about IN_BUCKET documents, bucket totals are summed up by source, and a
window runs within (source, bucket) only, so that a source with a third of all rows is spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

WEIGHTS = (5, 2, 1)
#: No document is repeated more often, and no target is above so many times its source.
MOST = 3
#: Documents of a source in a bucket, about: a source has as many buckets as that takes.
IN_BUCKET = 2_000
#: Characters that speak against a text, for the default weight.
JUNK = "#$%&*!|<>{}[]~^_=+@0123456789"


def quality(text: Column) -> Column:
    """A weight from 0.25 to 1: one less the share of junk characters, four times counted."""
    n = F.length(text)
    junk = n - F.length(F.translate(text, JUNK, ""))
    return F.coalesce(F.greatest(F.lit(0.25), F.lit(1.0) - F.lit(4.0) * junk / F.nullif(n, F.lit(0))), F.lit(0.25))


def draw(doc_id: Column, text: Column) -> Column:
    """A number between 0 and 1 from the doc_id alone, so that reruns agree; without a doc_id from the text."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.md5(text.cast("binary"))), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """skey, source_size, target: sources by code point, null last, share all words by weight, at most MOST times their
    own; what is above is shared again. One row a source, so the windows here hold as many rows as there are sources.

    With sources in the order of cap / weight, all before some place are at their cap, and the rest take `level` words a
    unit of weight: the first place where that level is not above its own cap / weight."""
    everything, earlier = Window.partitionBy(), Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    x = sizes.withColumn("place", place).withColumn("weight", weight.cast("double")).withColumn("cap", MOST * F.col("source_size").cast("double"))
    x = x.withColumn("ratio", F.col("cap") / F.col("weight"))
    x = x.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
    x = x.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything)["level"])
    return x.select("skey", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, weight: Column | None = None, row_key: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs (doc_id, text, source).

    taken is a whole number of times the size, 0 to MOST: a source's whole epochs, and once more for the documents that
    come first by key, up to the budget left; the document that crosses it is in if at least half of it fits. A null
    text has no words, a null source is a source, which is last. A null doc_id draws by its text. Rows that repeat
    each count; rows alike in all columns may change places. An empty table gives no rows. row_key adds a column of that
    name to tell rows by."""
    text = F.col("text")
    base = docs.select(
        F.col("doc_id").cast("long"),
        F.col("source"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (-F.log(draw(F.col("doc_id"), text)) / (quality(text) if weight is None else weight)).alias("key"),
        *([] if row_key is None else [row_key.alias("row_key")]),
    )
    base = materialize(base, "sized")
    sizes = materialize(base.groupBy("skey").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("documents")), "sources")
    buckets = F.greatest(F.ceil(F.col("documents") / IN_BUCKET), F.lit(1))  # keys are at most 4 times as far apart as for weight 1
    base = base.join(sizes.select("skey", buckets.alias("buckets")), "skey")
    base = base.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")), F.col("buckets") - 1).cast("long")).drop("buckets")
    sums = base.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    sizes = sizes.drop("documents")
    first = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("words").over(first), F.lit(0))).join(targets(sizes, weights), "skey")
    within = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    x = base.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets.drop("words"), ["skey", "bucket"])
    x = x.withColumn("epochs", F.coalesce(F.least(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(MOST)), F.lit(0)))
    more = (F.col("epochs") < MOST) & (F.col("before") + F.col("inside") + F.col("size") / 2 <= F.col("target") - F.col("epochs") * F.col("source_size"))
    extra = [] if row_key is None else ["row_key"]
    return x.select("doc_id", "size", "source_size", "target", *extra, (F.col("size") * (F.col("epochs") + more.cast("long"))).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns. Documents without words are not taken."""
    key = F.xxhash64(*[docs[c] for c in docs.columns])
    times = mix_sources(docs, row_key=key).filter("size > 0").groupBy("row_key").agg(F.sum(F.expr("taken div size")).alias("times"), F.count("*").alias("rows")).filter("times > 0")
    x = docs.select(key.alias("row_key"), F.struct(*[docs[c] for c in docs.columns]).alias("row")).join(times, "row_key")
    # of n equal rows each has its part of the times, the first ones one more
    place = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))
    x = x.withColumn("own", F.expr("times div rows") + (place <= F.col("times") % F.col("rows")).cast("long"))
    return x.filter("own > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("own").cast("int")))).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substring(md5(coalesce(doc_id::VARCHAR, 't' || md5(text), '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
    / coalesce(greatest(0.25::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (length(text) - length(translate(text, '#$%&*!|<>{}[]~^_=+@0123456789', ''))) / nullif(length(text), 0)), 0.25::DOUBLE) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, (CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, 3 * source_size::DOUBLE AS cap FROM p),
l AS (SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER e, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0)) AS level
  FROM w WINDOW e AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(level, place) FROM (SELECT level, row_number() OVER (ORDER BY ratio, place) AS place FROM l WHERE level <= ratio)) * weight), cap) AS target FROM l),
x AS (SELECT d.*, source_size, target, coalesce(least(floor(target / nullif(source_size, 0)), 3), 0) AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN epochs < 3 AND before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""
