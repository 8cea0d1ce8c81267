"""Operator 6: document quality by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its whole text. The weights come from preference pairs, a good
against a bad document, by logistic loss on the difference of their features. The threshold is the quantile of training
strengths at the share of bad documents, and a score of 0.5.

All labelled documents that may be learned from are: features are worked out once and kept as a table, means, slopes and
the quantile are sums and counts over it in tasks, and only those come to the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, held_out, materialize, releasing, scratch, shingles, table, word_hashes

#: Pairs at least; more where a kind has more documents than that, as each is in one.
PAIRS, ROUNDS, RIDGE = 40_000, 40, 1e-3
#: Rows that are ranked in a task at a time, and values that are sorted on the driver.
RANKED, FEW = 2_000, 10_000
THRESHOLD = 0.5
_KINDS = 9
_KIND = np.zeros(256, np.uint8)  # of UTF-8 bytes: 0 a byte of a longer character
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[0x20, 0x09]], _KIND[[0x0A, 0x0D, 0x0B, 0x0C]] = 4, 5
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 6
_KIND[[ord(c) for c in "|!"]] = 7
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?|!"]] = 8


def shares(texts: list[str | None]) -> np.ndarray:
    """Shares of kinds of characters, of capital, repeated and symbol-bearing words, of repeated lines and shingles, and
    lengths."""
    out = np.zeros((len(texts), _KINDS + 10))
    data = as_bytes(texts)
    hashes, at = word_hashes(data)
    for i, (text, a, b) in enumerate(zip(data, at[:-1], at[1:], strict=True)):
        kinds = np.zeros(_KINDS)
        for k in range(0, len(text), 1 << 20):
            kinds += np.bincount(_KIND[np.frombuffer(text[k : k + (1 << 20)], np.uint8)], minlength=_KINDS)
        w = hashes[a:b]
        n, n_words = max(1, len(text)), max(1, len(w))
        row = out[i]
        row[:_KINDS] = kinds / n
        row[_KINDS] = kinds[2] / max(1, kinds[1] + kinds[2])
        row[_KINDS + 1] = (kinds[7] + kinds[8]) / n_words
        if len(w):
            counts = np.sort(np.unique(w, return_counts=True)[1])[::-1]
            row[_KINDS + 2] = np.count_nonzero(w[1:] == w[:-1]) / n_words
            row[_KINDS + 3] = 1 - len(counts) / n_words
            row[_KINDS + 4] = counts[0] / (n_words + 20)
            s = shingles(w, 3)
            row[_KINDS + 5] = 1 - len(np.unique(s)) / len(s)
            row[_KINDS + 8] = np.log1p(len(w)) / 10
            row[_KINDS + 9] = min(1.0, n / n_words / 20)
        lines = text.split(b"\n")
        row[_KINDS + 6] = 1 - len(set(lines)) / len(lines)
        row[_KINDS + 7] = min(1.0, len(lines) / n_words)
    return out


def widened(x: np.ndarray) -> np.ndarray:
    """Each share also by its root, which sees small shares, and by whether it is above 0.05."""
    return np.concatenate([x, np.sqrt(np.abs(x)), x > 0.05], axis=1)


def features(texts: list[str | None]) -> np.ndarray:
    return widened(shares(texts))


def _slopes(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums over pairs of the loss's first and second derivatives."""
    p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
    return d.T @ (p - 1), d.T @ (d * (p * (1 - p))[:, None])


def _minimum(width: int, n: int, slopes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The weights where the mean loss of n pairs and a ridge are least, by Newton's method."""
    w = np.zeros(width)
    for _ in range(ROUNDS):
        first, second = slopes(w)
        slope = first / n + RIDGE * w
        w -= np.linalg.solve(second / n + (RIDGE + 1e-6) * np.eye(width), slope)
        if np.abs(slope).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> dict:
    """A model of rows at hand: PAIRS pairs of a good and a bad row, each drawn alike."""
    if len(y) == 0 or y.min() == y.max():
        return {"constant": 0.99 if len(y) == 0 or y[0] else 0.01}
    rng = np.random.default_rng(seed)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - centre) / scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = np.clip(z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)], -8, 8)
    w = _minimum(d.shape[1], len(d), lambda w: _slopes(d, w))
    s = np.clip(z, -8, 8) @ w
    return {"centre": centre, "scale": scale, "weights": w, "cut": float(np.quantile(s, (y == 0).mean())), "unit": float(s.std() / 2 + 1e-9)}


def _strengths(model: dict, x: np.ndarray) -> np.ndarray:
    return np.clip((x - model["centre"]) / model["scale"], -8, 8) @ model["weights"]


def _scores(model: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip((_strengths(model, x) - model["cut"]) / model["unit"], -30, 30)))


def scores(model: dict, texts: list[str | None]) -> np.ndarray:
    return np.full(len(texts), model["constant"]) if "constant" in model else _scores(model, features(texts))


def score_column(model: dict):
    """A function of a text column: its score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in releasing(batches):
            parts = [scores(model, list(texts[i : i + 500])) for i in range(0, len(texts), 500)]
            yield pd.Series(np.concatenate(parts or [np.zeros(0)]))

    return score


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, x (shares) of every row of docs."""

    @F.pandas_udf("array<double>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in releasing(batches):
            yield pd.Series([x for i in range(0, len(texts), 500) for x in shares(list(texts[i : i + 500]))], dtype=object)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), measure("text").alias("x"))


def _summed(rows: DataFrame, each: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum of an array of each batch of rows; a task hands over one."""

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = [each(frame) for frame in frames if len(frame)]
        if some:
            yield pd.DataFrame({"sums": [np.sum(some, axis=0).tobytes()]})

    found = sorted(r["sums"] for r in rows.mapInPandas(total, "sums binary").collect())  # in the same order each time
    return np.sum([np.frombuffer(x) for x in found], axis=0)


def pairs(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """good, bad: the x of pairs of rows (doc_id, y, x). Each row is in one: the rarer kind is gone round as often as the
    other needs, and both so often that there are PAIRS pairs."""
    more, less = (1, 0) if counts[1] >= counts[0] else (0, 1)
    n_more, n_less = counts[more], counts[less]
    buckets = 1 + (n_more + n_less) // RANKED
    x = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    per = x.groupBy("y", "bucket").count()  # a row for each RANKED documents or so
    before = F.coalesce(F.sum("count").over(Window.partitionBy("y").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("y", "bucket").orderBy("doc_id")) - 1
    ranked = x.join(per.select("y", "bucket", before.alias("before")), ["y", "bucket"]).select("y", rank.alias("rank"), "x")
    times = -(-PAIRS // n_more)
    turn = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    many = ranked.filter(F.col("y") == more).select("rank", F.col("x").alias("one"), turn.alias("turn"))
    many = many.select("one", F.pmod(F.col("rank") + F.col("turn") * F.lit(max(1, n_less // times)), F.lit(n_less)).alias("rank"))
    both = many.join(ranked.filter(F.col("y") == less).select("rank", F.col("x").alias("other")), "rank")
    return both.select(F.col("one" if more else "other").alias("good"), F.col("other" if more else "one").alias("bad"))


def nth(values: DataFrame, n: int) -> float:
    """The n-th least, from 0, of a column s without nulls: counted in steps of the range that it is in, until few are left."""
    low, high, left = values.agg(F.min("s"), F.max("s"), F.count("s")).first()
    while low < high:
        inside = values.filter(F.col("s").between(low, high))
        step = (high - low) / 1000
        if left <= FEW or step == 0:
            return sorted(r["s"] for r in inside.collect())[n]
        part = F.least(F.floor((F.col("s") - low) / step), F.lit(999))
        for _, low, high, left in sorted(tuple(r) for r in inside.groupBy(part.alias("part")).agg(F.min("s"), F.max("s"), F.count("s")).collect()):
            if n < left:
                break
            n -= left
    return low


def train(found: DataFrame, labels: DataFrame) -> dict:
    """A model of all labelled documents that may be learned from; found: measured documents.

    Rows with null labels or ids are left out; of rows that repeat a doc_id one, with the least x, is taken."""
    spark = found.sparkSession
    some = labels.filter(~held_out(3, 1) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    kinds = some.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality").cast("int") != 0).cast("int").alias("y"))
    with scratch(spark):
        rows = materialize(found.join(kinds, "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")), "learned")
        counts = {0: 0, 1: 0} | {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
        n = counts[0] + counts[1]
        if not counts[0] or not counts[1]:
            return {"constant": 0.99 if n == 0 or counts[1] else 0.01}
        wide = lambda column: widened(np.stack(column))
        centre = _summed(rows, lambda frame: wide(frame["x"]).sum(axis=0)) / n
        scale = np.sqrt(_summed(rows, lambda frame: ((wide(frame["x"]) - centre) ** 2).sum(axis=0)) / n) + 1e-6
        width = len(centre)
        both = materialize(pairs(rows, counts), "pairs")

        def slopes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            def each(frame: pd.DataFrame) -> np.ndarray:
                first, second = _slopes(np.clip((wide(frame["good"]) - wide(frame["bad"])) / scale, -8, 8), w)
                return np.append(first, second)

            sums = _summed(both, each)
            return sums[:width], sums[width:].reshape(width, width)

        model = {"centre": centre, "scale": scale, "weights": _minimum(width, both.count(), slopes)}

        @F.pandas_udf("double")
        def strength(x: pd.Series) -> pd.Series:
            return pd.Series(_strengths(model, widened(np.stack(x))) if len(x) else [], dtype=float)

        values = materialize(rows.select(strength("x").alias("s")), "strengths")
        at = (n - 1) * (counts[0] / n)
        low = nth(values, int(at))
        high = nth(values, min(n - 1, int(at) + 1))
        return model | {"cut": low + (high - low) * (at - int(at)), "unit": values.agg(F.stddev_pop("s")).first()[0] / 2 + 1e-9}


def score_quality(docs: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text), learned from labels (doc_id, quality).

    A null text is scored as an empty one. Rows that repeat are scored each. Without labels of both kinds the score is
    one constant. An empty table gives no rows."""
    if model is None:
        found = materialize(measured(docs), "features")
        model = train(found, labels)

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(_scores(model, widened(np.stack(x))) if len(x) else [], dtype=float)

        scored = F.lit(model["constant"]) if "constant" in model else score("x")
    else:
        found, scored = docs, score_column(model)(F.col("text"))
    x = found.select(F.col("doc_id").cast("long"), held_out(3, 1).alias("held_out"), scored.alias("score"))
    return x.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
