"""Operator 3: toxicity by a convolutional text classifier in numpy.

Words (runs of letters, lower-cased) are hashed into an embedding table, and so are their first letters, which stand for
the forms of a word that were not met; the two are added. Filters over 1, 2 and 3 words, rectified and
pooled by their maximum over the whole text, feed a logistic output. It is trained by Adam on a bounded sample. For
scoring, each filter's product with each embedding is tabled once, so that a text costs a few look-ups a word.

Thresholds are calibrated by language: the language is told from the words alone, by log probabilities from the
training texts, and the logit is shifted so that each language's threshold is a score of 0.7."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, letter_words, release, releasing, table
from .learning import sample_rows

BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.02, 1e-5
#: Thresholds are calibrated on scores out of so many folds.
FOLDS = 3
#: A word must be in so many training texts to have an embedding.
LEAST_TEXTS = 3
THRESHOLD = 0.7
#: A language with fewer toxic texts to calibrate on takes the threshold of all.
LEAST_TOXIC = 15
_PAD = max(WIDTHS)  # so that an empty text has a window of each width
#: Of no word; words come before BUCKETS, first letters before it.
_EMPTY = 2 * BUCKETS


def word_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids (word and first letters), with _PAD empty pairs after each text, and where each text starts."""
    hashes, at = letter_words(texts)
    ids = np.full((len(hashes) + _PAD * len(texts), 2), _EMPTY, np.int32)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    ids[np.arange(len(hashes)) + _PAD * owner] = (hashes >> np.uint64(48)).astype(np.int32) & (BUCKETS - 1) | np.array([0, BUCKETS], np.int32)
    return ids, at[:-1] + _PAD * np.arange(len(texts))


def _forward(x: np.ndarray, starts: np.ndarray, kernels: list[np.ndarray], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima over each text (texts by filters of all widths), and where they are."""
    ends = np.append(starts[1:], len(x))
    top, place = [], []
    for w, kernel in zip(WIDTHS, kernels, strict=True):
        n = len(x) - w + 1
        z = sum(x[j : j + n] @ kernel[j] for j in range(w))
        where = np.array([a + z[a : b - w + 1].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])  # no window reaches into the next text
        place.append(where)
        top.append(np.take_along_axis(z, where, axis=0))
    return np.concatenate(top, axis=1) + bias, np.concatenate(place, axis=1)


def _train(ids: list[np.ndarray], y: np.ndarray, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    texts_with, toxic_with = np.zeros(_EMPTY + 1), np.zeros(_EMPTY + 1)
    for x, label in zip(ids, y, strict=True):
        u = np.unique(x)
        texts_with[u] += 1
        toxic_with[u] += label
    known = texts_with >= LEAST_TEXTS
    known[_EMPTY] = False
    rate = (y.sum() + 1) / (len(y) + 2)
    odds = np.log((toxic_with + 2 * rate) / (texts_with - toxic_with + 2 * (1 - rate)) * (1 - rate) / rate)
    known = np.flatnonzero(known)  # all others have no embedding: they are row 0 of the table trained
    row = np.zeros(_EMPTY + 1, np.int32)
    row[known] = np.arange(1, len(known) + 1)
    ids = [row[x] for x in ids]
    e = rng.normal(0, 0.1, (len(known) + 1, SIZE)).astype(np.float32)
    e[1:, 0] = odds[known] / 3
    e[0] = 0
    kernels = [rng.normal(0, 0.2, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for k in kernels:
        k[:, 0, 0] = 1 / len(k)
    out = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
    params = [e, *kernels, np.zeros_like(out), out, np.array([np.log(rate / (1 - rate))], np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            flat = np.concatenate([ids[i] for i in some])
            starts = np.cumsum([0] + [len(ids[i]) for i in some[:-1]])
            e, kernels, bias, out, c = params[0], params[1:-3], params[-3], params[-2], params[-1]
            x = e[flat[:, 0]] + e[flat[:, 1]]
            top, place = _forward(x, starts, kernels, bias)
            h = np.maximum(top, 0)
            d = ((1 / (1 + np.exp(-np.clip(h @ out + c, -30, 30))) - y[some]) / len(some)).astype(np.float32)
            dh = d[:, None] * out * (top > 0)
            de, dk = np.zeros_like(e), []
            for i, (w, kernel) in enumerate(zip(WIDTHS, kernels, strict=True)):
                g, where = dh[:, i * FILTERS : (i + 1) * FILTERS], place[:, i * FILTERS : (i + 1) * FILTERS]
                grad = np.zeros_like(kernel)
                for j in range(w):
                    grad[j] = np.einsum("bfd,bf->df", x[where + j], g)
                    step_e = g[:, :, None] * kernel[j].T[None]
                    for both in (0, 1):
                        np.add.at(de, flat[where + j, both], step_e)
                dk.append(grad)
            de[0] = 0
            step += 1
            for p, grad, m, v in zip(params, [de, *dk, dh.sum(axis=0), h.T @ d, d.sum(keepdims=True)], first, second, strict=True):
                grad = grad + DECAY * p
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    full = np.zeros((_EMPTY + 1, SIZE))
    full[known] = params[0][1:]
    return {
        "tables": [[(full @ k[j]).astype(np.float32) for j in range(len(k))] for k in params[1:-3]],
        "bias": params[-3],
        "out": params[-2],
        "c": float(params[-1][0]),
    }


def logits(model: dict, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if len(starts) == 0:
        return np.zeros(0)
    top, ends = [], np.append(starts[1:], len(ids))
    for w, tables in zip(WIDTHS, model["tables"], strict=True):
        n = len(ids) - w + 1
        z = tables[0][ids[:n, 0]]
        z += tables[0][ids[:n, 1]]
        for j in range(1, w):
            z += tables[j][ids[j : j + n, 0]]
            z += tables[j][ids[j : j + n, 1]]
        for j in range(1, w):
            z[ends[:-1] - j] = -np.inf  # windows that reach into the next text
        top.append(np.maximum.reduceat(z, starts, axis=0))
    return np.maximum(np.concatenate(top, axis=1) + model["bias"], 0) @ model["out"] + model["c"]


def language_of(model: dict, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The index of the most probable language of each text by its words; 0 if there is nothing to tell it by."""
    if len(starts) == 0 or model["words"].shape[1] < 2:
        return np.zeros(len(starts), int)
    return np.add.reduceat(model["words"][ids[:, 0]], starts, axis=0).argmax(axis=1)


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap where F1 is best."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(f1.argmax())
    low = z[order[best + 1]] if best + 1 < len(z) else z[order[best]] - 2
    return float((z[order[best]] + low) / 2)


def fit(rows: list[tuple[str, int, str | None]]) -> dict:
    """Learns from (text, label, lang) without a fold, calibrates the thresholds on it, by turns, then learns from all.

    The list is emptied on the way."""
    texts, y = [r[0] for r in rows], np.array([float(r[1]) for r in rows])
    if len(rows) == 0 or y.min() == y.max():
        constant = float(y[0]) if len(y) else 0.0
        return {"constant": 0.99 if constant else 0.01}
    ids = [word_ids([t])[0] for t in texts]
    langs = [r[2] for r in rows]
    n = len(rows)
    rows.clear()  # the words are all that is needed of the texts
    del texts
    names = sorted({x for x in langs if x is not None})
    words = np.zeros((_EMPTY + 1, max(1, len(names))))
    for x, lang in zip(ids, langs, strict=True):
        if lang is not None:
            np.add.at(words[:, names.index(lang)], x[:-_PAD, 0], 1)
    words = np.log((words + 0.05) / (words.sum(axis=0) + 0.05 * BUCKETS))
    words[_EMPTY] = 0
    fold = np.arange(n) % FOLDS
    out_of_fold = np.zeros(n)
    for k in range(FOLDS):
        part = _train([x for x, f in zip(ids, fold, strict=True) if f != k], y[fold != k])
        for i in np.flatnonzero(fold == k):
            out_of_fold[i] = logits(part, ids[i], np.array([0]))[0]
    model = _train(ids, y) | {"words": words.astype(np.float32)}
    group = np.array([language_of(model, x, np.array([0]))[0] for x in ids])
    shift = np.full(words.shape[1], _threshold(out_of_fold, y))
    for g in range(len(shift)):
        own = group == g
        if y[own].sum() >= LEAST_TOXIC and y[own].sum() < own.sum():
            shift[g] = _threshold(out_of_fold[own], y[own])
    return model | {"shift": shift}


def packed(model: dict) -> dict:
    """A model whose tables are without the rows of words that were not met, which are all alike."""
    if "constant" in model or "rows" in model:
        return model
    flat = np.concatenate([table for tables in model["tables"] for table in tables], axis=1)
    rows = np.flatnonzero(flat.any(axis=1))
    usual = model["words"].min(axis=0)
    met = np.flatnonzero((model["words"] != usual).any(axis=1))
    return model | {"rows": rows, "tables": flat[rows], "words": (usual, met, model["words"][met])}


def unpacked(model: dict) -> dict:
    if "rows" not in model:
        return model
    flat = np.zeros((_EMPTY + 1, model["tables"].shape[1]), np.float32)
    flat[model["rows"]] = model["tables"]
    columns = iter(np.split(flat, sum(WIDTHS), axis=1))
    usual, met, some = model["words"]
    words = np.tile(usual, (_EMPTY + 1, 1))
    words[met] = some
    full = model | {"tables": [[np.ascontiguousarray(next(columns)) for _ in range(w)] for w in WIDTHS], "words": words}
    del full["rows"]
    return full


def scores(model: dict, texts: list[str | None]) -> np.ndarray:
    model = unpacked(model)
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    ids, starts = word_ids([x or "" for x in texts])
    z = logits(model, ids, starts) - model["shift"][language_of(model, ids, starts)]
    return 1 / (1 + np.exp(-np.clip(z + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def _parts(texts: list[str | None], most: int = 1 << 20) -> Iterator[list[str | None]]:
    part, size = [], 0
    for x in texts:
        if part and size + len(x or "") > most:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x or "")
    if part:
        yield part


def score_column(model: dict):
    """A function of a text column: its score. The model travels packed."""
    small = packed(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        full = unpacked(small)
        for texts in releasing(batches):
            yield pd.Series(np.concatenate([scores(full, part) for part in _parts(list(texts))] or [np.zeros(0)]))

    return score


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The packed model, learned in a task: the driver holds neither texts nor tables of words."""

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((r for x in frames for r in zip(x["h"], x["doc_id"], x["text"], x["y"], x["lang"], strict=True)), key=lambda r: r[:2])
        rows = [r[2:] for r in rows]
        yield pd.DataFrame({"model": [pickle.dumps(packed(fit(rows)))]})
        release()

    found = sample_rows(docs, labels, "toxic", ~held_out(3, 1)).coalesce(1).mapInPandas(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])


def score_toxicity(docs: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text), learned from labels (doc_id, toxic).

    A null text is scored as an empty one. Rows that repeat are scored each. Without labels of both kinds the score is
    one constant. An empty table gives no rows."""
    model = train(docs, labels) if model is None else model
    x = docs.select(F.col("doc_id").cast("long"), held_out(3, 1).alias("held_out"), score_column(model)(F.col("text")).alias("score"))
    return x.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is below the threshold, with their columns."""
    return docs.filter(score_column(train(docs, labels))(F.col("text")) < THRESHOLD)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
