"""Operator 5: exact top-k inner product search over a pivot-distance index.

Each vector is keyed by its nearest pivot and its distance to it, and the index is written in that order, cut into ranges
so that one cell may spread over many tasks. A query needs vectors of at least some score, by its best so far: with
|q - x|^2 = |q|^2 + |x|^2 - 2 q.x that bounds the distance to x, and by the triangle inequality x's distance to a pivot lies
in an annulus about the query's own. Annuli are scored by matrix products in integers, those nearest to most queries
first, and the bound tightens on the way. The first bound is each query's k-th best score among the bounded sample that
the pivots come from: these are rows of the table, so nothing is lost by it.

Queries are broadcast in chunks of at most CHUNK; the vectors are not shuffled for them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_folder, shuffle_partitions, table

K, EVERY, SCALE = 5, 50, 256
SAMPLE, PIVOTS, CHUNK, ANNULUS = 2048, 64, 4096, 512
_EXACT_32, _EXACT_64, _EXACT_INTEGER = float(1 << 24), float(1 << 53), float(1 << 62)


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, v (floor(256 x), whole numbers as doubles) of the rows that take part: no null, all components finite."""
    e = F.col("embedding")
    v = F.transform(e, lambda x: x.cast("double"))
    good = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    # rint finds no fraction to round above 2^52; there and below, the whole number at most x is it or the one before
    floor = lambda x: F.when(F.rint(x) > x, F.rint(x) - 1.0).otherwise(F.rint(x))
    return vectors.select("vec_id", "embedding").filter(good).select(F.col("vec_id").cast("long"), F.transform(v, lambda x: floor(x * float(SCALE))).alias("v"))


def _matrix(values, size: int) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in values], np.float64).reshape(len(values), size)


def _product(a: np.ndarray, b: np.ndarray, own: np.ndarray) -> np.ndarray:
    """a @ b.T as 64-bit integers, exactly: in floats where these are exact, which BLAS multiplies, in integers where these
    are wide enough, and else in Python's. A product beyond 64 bits is an error, but for those of rows with themselves."""
    with np.errstate(over="ignore"):
        most = max(1, a.shape[1]) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < _EXACT_32:
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)
    if most < _EXACT_64:
        return (a @ b.T).astype(np.int64)
    if most < _EXACT_INTEGER:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    wide = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    wide[own] = 0
    if any(abs(x) >= 1 << 63 for x in wide.flat):
        raise OverflowError("the inner product of two vectors does not fit into 64 bits")
    return wide.astype(np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Not finite where squares overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Farthest-first from the first row: pivots that are spread out, no two alike."""
    chosen, away = [0], _distances(sample, sample[:1])[:, 0]
    while len(chosen) < most and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def build_index(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, v, pivot, distance of every vector, all of the pivots' length, in ranges of (pivot, distance)."""
    size = pivots.shape[1]

    def key(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                away = _distances(_matrix(frame["v"], size), pivots)
                nearest = away.argmin(axis=1)
                yield frame.assign(pivot=nearest.astype(np.int32), distance=away[np.arange(len(frame)), nearest])

    keyed = vectors.mapInPandas(key, "vec_id long, v array<double>, pivot int, distance double")
    order = ("pivot", "distance", "vec_id")
    return materialize(keyed.repartitionByRange(shuffle_partitions(vectors.sparkSession), *order).sortWithinPartitions(*order), "index")


class _Best:
    """The k best rows of each query so far, ties to smaller ids."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int):
        self.q, self.ids, self.k = queries, ids, k
        with np.errstate(over="ignore"):
            self.norms = (queries**2).sum(1)
        self.least = least.astype(np.int64)  # scores below are not needed
        self.rows = [np.zeros(0, np.int64)] * 3  # query, score, id

    def annulus(self, v: np.ndarray, ids: np.ndarray, active: np.ndarray) -> None:
        own = self.ids[active][:, None] == ids
        some = (score := _product(self.q[active], v, own)) >= self.least[active][:, None]
        some &= ~own
        at, row = np.nonzero(some)
        if not len(at):
            return
        query, score, found = (np.concatenate(x) for x in zip(self.rows, (active[at], score[at, row], ids[row]), strict=True))
        order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = place < self.k
        self.rows = [query[keep], score[keep], found[keep]]
        last = place[keep] == self.k - 1
        self.least[self.rows[0][last]] = np.maximum(self.least[self.rows[0][last]], self.rows[1][last])


def search(index: DataFrame, pivots: np.ndarray, queries: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int = K) -> DataFrame:
    """query_id, vec_id, score: for each task its k best rows of each query, of at least the given score."""
    to_pivots, size = _distances(queries, pivots), pivots.shape[1]
    with np.errstate(over="ignore"):
        pivot_norms = np.sqrt((pivots**2).sum(1))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore", invalid="ignore"):
            yield from scanned(frames)

    def scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(queries, ids, least, k)
        for frame in frames:
            for pivot, cell in frame.groupby("pivot", sort=False):
                cell = cell.sort_values("distance")  # a task reads files in any order, and so pieces of one cell
                v, vec_ids, r = _matrix(cell["v"], size), cell["vec_id"].to_numpy(), cell["distance"].to_numpy()
                longest = (v**2).sum(1).max()
                own = to_pivots[:, pivot]
                # distances are of rounded squares: by so much they may be wrong
                slack = 1e-6 + 4e-6 * (np.sqrt(best.norms) + np.sqrt(longest) + pivot_norms[pivot])
                starts = np.arange(0, len(r), ANNULUS)
                middle = np.median(own)
                for a in starts[np.argsort(np.abs(r[np.minimum(starts + ANNULUS // 2, len(r) - 1)] - middle), kind="stable")]:
                    b = min(a + ANNULUS, len(r))
                    reach = best.norms + longest - 2.0 * best.least + 1e-12 * (best.norms + longest + 2.0 * np.abs(best.least.astype(np.float64)))
                    width = np.sqrt(np.maximum(reach, 0)) * (1 + 1e-9) + slack
                    # of components so large that squares overflow nothing is known, and nothing is left out
                    active = np.flatnonzero(~((reach < 0) | (own - width > r[b - 1]) | (own + width < r[a])))
                    if len(active):
                        best.annulus(v[a:b], vec_ids[a:b], active)
        query, score, found = best.rows
        yield pd.DataFrame({"query_id": ids[query], "vec_id": found, "score": score})

    return index.select("vec_id", "v", "pivot", "distance").mapInPandas(scan, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by `every` its k best others.

    Vectors (vec_id, embedding) that are null or hold a null or non-finite component, and those without a vec_id, take no
    part. Vectors of different lengths have no inner product and are not each other's candidates; empty ones have 0. A score
    that does not fit into 64 bits is an error. Of rows that repeat a vec_id each is a candidate for others, and the least
    vector is the query. Fewer than k others give fewer rows; an empty table gives none. Other columns are ignored."""
    spark = vectors.sparkSession
    given = quantized(vectors)
    asked = given.groupBy(F.size("v").alias("size")).agg(F.max((F.col("vec_id") % every == 0).cast("int")).alias("some")).filter("some = 1")
    sizes = sorted(r["size"] for r in asked.select("size").collect())  # lengths of vectors: mostly one
    if not sizes:
        return spark.createDataFrame([], RESULT)
    path = f"{shared_folder(spark)}/best-{uuid.uuid4().hex}"
    for size in sizes:
        _top_k_of_size(given.filter(F.size("v") == size), size, every, k, path)
    return spark.read.schema(RESULT).parquet(path)


RESULT = "query_id long, rank int, vec_id long, score long"


def _top_k_of_size(given: DataFrame, size: int, every: int, k: int, path: str) -> None:
    """Append the results of the vectors of one length."""
    picked = given.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()  # SAMPLE rows
    sample, sample_ids = _matrix([r["v"] for r in picked], size), np.array([r["vec_id"] for r in picked], np.int64)
    pivots = choose_pivots(sample)
    index = build_index(given, pivots)
    asking = index.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asking = materialize(asking.withColumn("h", F.xxhash64("vec_id")), "queries")
    chunks = max(1, -(-asking.count() // (CHUNK // 2)))  # half full on average, so that none is much over CHUNK
    none = np.iinfo(np.int64).min >> 2
    for chunk in range(chunks):  # a bounded chunk at a time is here and in the tasks
        rows = sorted(asking.filter(F.pmod("h", F.lit(chunks)) == chunk).select("vec_id", "v").collect(), key=lambda r: r["vec_id"])
        q = _matrix([r["v"] for r in rows], size)
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        least = np.full(len(rows), none)
        if len(sample) > k and len(rows):
            own = ids[:, None] == sample_ids
            scores = np.where(own, none, _product(q, sample, own))
            least = np.sort(scores, axis=1)[:, -k]
        found = search(index, pivots, q, ids, least, k)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        found.withColumn("rank", rank).filter(f"rank <= {k}").select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5
"""
