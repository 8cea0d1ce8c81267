"""Operator 7: language identification with a string kernel.

The kernel of two texts is the blended spectrum of their n-grams of 1 to 3 letters, by presence: for each n, the shared
distinct n-grams over the root of both counts, summed. Nystrom landmarks map a text to the kernels with a bounded sample
of texts, whitened; kernel ridge regression on that map gives one score for each language, one against the rest. Scoring
is batched: a batch's presence matrix times the landmarks' presence matrix, then times the weights.

N-grams are hashed into WIDTHS columns, so that a presence matrix has a fixed width whatever the alphabet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, letters, materialize, release, releasing, table

#: Columns for the n-grams of each length.
WIDTHS = (512, 2048, 5632)
#: Documents of each language to learn from, landmarks among them, languages at most (those of most documents), the ridge.
SAMPLE, LANDMARKS, LANGUAGES, RIDGE = 750, 48, 256, 1e-2
#: Parts of a language that are ranked by themselves first.
PARTS = 64
UNKNOWN = "und"
_ROWS, _CHARS = 256, 1 << 19
_BASE = np.concatenate([[0], np.cumsum(WIDTHS)])


def presence(texts: list[str]) -> np.ndarray:
    """A row for each text: 1 where it has an n-gram of that column. Runs of other characters count as one break."""
    out = np.zeros((len(texts), _BASE[-1]), bool)
    flat = out.reshape(-1)
    i = 0
    while i < len(texts):
        rows, size = [], 0
        if len(texts[i]) > _CHARS:  # a very long text by itself, in parts that begin with the two codes before
            codes = np.zeros(1, np.uint32)
            for at in range(0, len(texts[i]), _CHARS):
                last = [np.zeros(1, np.uint32)] if at + _CHARS >= len(texts[i]) else []
                codes = np.concatenate([codes[-2:], letters(texts[i][at : at + _CHARS]), *last])
                codes = codes[(codes != 0) | np.append(True, codes[:-1] != 0)]
                _mark(flat, codes, np.full(len(codes), i * int(_BASE[-1]), np.int64))
            i += 1
            continue
        while i < len(texts) and size + len(texts[i]) <= _CHARS:
            rows.append(i)
            size += len(texts[i])
            i += 1
        a = letters(" " + "  ".join(texts[r] for r in rows) + " ")
        sizes = [len(texts[r]) + 2 for r in rows]
        owner = np.repeat(np.array(rows, np.int64) * int(_BASE[-1]), sizes)
        keep = (a != 0) | np.append(True, a[:-1] != 0)
        keep[np.cumsum([0, *sizes[:-1]])] = True
        _mark(flat, a[keep], owner[keep])
    return out


def _mark(flat: np.ndarray, a: np.ndarray, owner: np.ndarray) -> None:
    """Mark the n-grams of codes; owner is where each code's row starts."""
    a = a.astype(np.uint32)
    m = np.uint32
    one = a * m(2654435761)
    two = (a[:-1] * m(40503) + a[1:]) * m(2246822519)
    three = ((a[:-2] * m(40503) + a[1:-1]) * m(2654435769) + a[2:]) * m(3266489917)
    for n, codes in enumerate((one, two, three)):
        column = ((codes >> m(16)).astype(np.int64) * WIDTHS[n] >> 16) + _BASE[n]
        inside = owner[: len(codes)] == owner[n:]
        some = a[: len(codes)] != 0
        for j in range(1, n + 1):
            some |= a[j : j + len(codes)] != 0
        flat[(owner[: len(codes)] + column)[inside & some]] = True


def normed(marks: np.ndarray) -> np.ndarray:
    """Presence rows with unit length for each n, so that products of two rows are kernels."""
    x = marks.astype(np.float32)
    for a, b in zip(_BASE[:-1], _BASE[1:], strict=True):
        x[:, a:b] /= np.sqrt(np.maximum(x[:, a:b].sum(axis=1, keepdims=True), 1))
    return x


def fit(marks: np.ndarray, langs: list[str]) -> dict:
    """Landmarks, weights (landmarks by languages) and the languages, from presence rows and their languages; the first
    LANDMARKS rows of each language are landmarks."""
    names = sorted(set(langs))
    if not names:
        return {"names": [], "landmarks": np.zeros((0, int(_BASE[-1])), np.float32), "weights": np.zeros((0, 0), np.float32)}
    by = {name: [i for i, x in enumerate(langs) if x == name] for name in names}
    landmarks = normed(marks[[i for name in names for i in by[name][:LANDMARKS]]])
    kernel = np.concatenate([normed(marks[i : i + _ROWS]) @ landmarks.T for i in range(0, len(marks), _ROWS)]).astype(np.float64)
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    use = values > 1e-6 * values.max()
    white = vectors[:, use] / np.sqrt(values[use])
    mapped = kernel @ white
    goal = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    weight = 1 / np.array([len(by[x]) for x in langs])[:, None]  # each language counts alike
    left = mapped.T @ (mapped * weight) + RIDGE * np.eye(mapped.shape[1])
    return {"names": names, "landmarks": landmarks, "weights": (white @ np.linalg.solve(left, mapped.T @ (goal * weight))).astype(np.float32)}


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The best language of each text, its share among all, and how far it leads the second best, which does not depend on
    how many languages there are."""
    names, scores, leads = [], np.zeros(len(texts)), np.zeros(len(texts))
    for at in range(0, len(texts), _ROWS):
        part = [x or "" for x in texts[at : at + _ROWS]]
        marks = presence(part)
        some = marks[:, : WIDTHS[0]].any(axis=1)
        if not model["names"]:
            names += [UNKNOWN] * len(part)
            continue
        raw = (normed(marks) @ model["landmarks"].T) @ model["weights"]
        shares = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))
        best = raw.argmax(axis=1)
        scores[at : at + len(part)] = np.where(some, 1 / shares.sum(axis=1), 0.0)
        second = np.partition(raw, -2, axis=1)[:, -2] if raw.shape[1] > 1 else -1.0
        leads[at : at + len(part)] = np.where(some, raw.max(axis=1) - second, 0.0)
        names += [model["names"][b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
    return names, scores, leads


def train(docs: DataFrame) -> dict:
    """A model from SAMPLE documents of each language, those with the least hashes of doc_id among the ones that may be
    learned from and have letters. Whole texts become rows of bits where they are; only these reach the driver."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang"), F.col("text"))
    x = x.filter(~held_out(4, 2) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    ids = x.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct()
    most = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    # each task ranks its own rows first and passes on no more than are asked for; then so do PARTS parts of a language
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy("h", "doc_id"))
    ids = ids.join(F.broadcast(most), "lang").withColumn("part", F.pmod("h", F.lit(PARTS)))
    ids = ids.withColumn("rank", rank("part")).filter(F.col("rank") <= SAMPLE).withColumn("rank", rank()).filter(F.col("rank") <= SAMPLE)
    ids = materialize(ids.drop("part"), "languages")

    @F.pandas_udf("binary")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series([row.tobytes() for at in range(0, len(texts), _ROWS) for row in np.packbits(presence(list(texts[at : at + _ROWS])), axis=1)])

    found = x.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("lang", "rank").agg(F.min("text").alias("text")).select("lang", "rank", bits("text").alias("bits")).collect()
    found = sorted(found, key=lambda r: (r["rank"], r["lang"]))
    marks = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in found), np.uint8).reshape(-1, (int(_BASE[-1]) + 7) // 8), axis=1, count=int(_BASE[-1])).astype(bool)
    model = fit(marks, [r["lang"] for r in found])
    release()
    return model


def language_column(model: dict):
    """A function of a text column: a struct of lang_pred, score and lead."""

    @F.pandas_udf("lang_pred string, score double, lead double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in releasing(batches):
            names, scores, leads = predict(model, list(texts))
            yield pd.DataFrame({"lang_pred": names, "score": scores, "lead": leads})

    return score


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang).

    A null text, or one without letters, is `und` with score 0; so is every text if nothing could be learned. Rows that
    repeat are scored each, very long texts in parts whose n-grams are joined. An empty table gives no rows."""
    model = train(docs) if model is None else model
    x = docs.select(F.col("doc_id").cast("long"), held_out(4, 2).alias("held_out"), language_column(model)(F.col("text")).alias("p"))
    return x.select("doc_id", "held_out", "p.lang_pred", "p.score")


#: Texts whose best language leads the second best by less are rejected: one in the language of its landmarks leads by
#: about 2, one of which the model can tell nothing by 0.
LEAST_LEAD = 1e-6


def with_language(docs: DataFrame) -> DataFrame:
    """The rows of docs that are in some language, with their columns: neither `und` nor with a lead below LEAST_LEAD."""
    p = language_column(train(docs))(F.col("text"))
    return docs.filter((p["lang_pred"] != UNKNOWN) & (p["lead"] >= LEAST_LEAD))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
