"""Operator 9: n-gram Jaccard join with PartEnum signatures.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Documents of equal sets are one node from the start,
named by a hash of the set. Every link between different sets is found (hash collisions aside), in these steps:

1. For each set it is counted how many of its shingles any other set has. One with fewer than three quarters of them has
   no partner, as at most a quarter of a set can lie outside of a linked one.
2. PartEnum: sets fall into overlapping bands of size such that linked sets share a band. In a band, linked sets differ
   by at most d shingles. The domain is cut into first-level parts, each into CELLS cells; in some part at most one cell
   differs, so one of its subsets of CELLS - 1 cells is equal in both sets, and its content is a signature that they share.
   Subsets that are empty in a set are no signature. Whether the rest still suffices is checked for each set, by counting
   how many differing shingles it takes to spoil all; a set for which d can do so also gives each shingle as a signature.
   A pair would be lost only if that held for both, and such sets meet in their shingles.
3. Sets that share a signature are compared with the smallest of them, exactly. Where that does not join all of a
   cluster into one component, another star follows, from a set not used yet, STARS in all. Of what is not joined then,
   all pairs are looked at that may still be linked by size and by the triangle inequality of the Jaccard distance, in
   blocks inside of tasks: the most likely pairs of two components are compared first, and then all that are left.
   Bitmaps of the sets rule out most pairs before the sets themselves are moved.

Hashes travel as packed numpy arrays by range of the hash. The number of ranges follows the number of hashes, so that a
range is as many hashes at any size, and so that the bits kept of a hash within its range tell hashes apart equally well:
two that are not told apart can make a set look able to have a partner, or two sets be compared, but no link. Of a set's
name 40 bits are kept while shingles are counted; a link would be lost if those of two linked sets were the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, as_bytes, materialize, mix, releasing, scratch, shingles, shuffle_partitions, small_batches, table, word_hashes
from .components import connected

WIDTH = 5
#: Two sets link when 100 * shared >= SIMILARITY * union.
SIMILARITY = 75
CELLS = 3
#: Bands begin at sizes that grow by this factor.
STEP = 1.5
#: Packed hashes that a task holds before it sends them on, hashes in a range, and sets in a range of sets: the numbers of
#: ranges follow these, so that a range is as much work at any size.
HELD, RANGE, SETS = 2_000_000, 1 << 18, 1 << 13
#: Signatures for each shingle of a set, about.
EACH = 4
#: Stars before the pairs that are left are compared in blocks, and members of a cluster in a block.
STARS, MEMBERS = 1, 256
_U = np.uint64


def sets_of(texts: list[str | None]) -> list[np.ndarray]:
    hashes, at = word_hashes(as_bytes(texts))
    return [np.unique(shingles(hashes[a:b], WIDTH)) for a, b in zip(at[:-1], at[1:], strict=True)]


def name_of(found: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed number."""
    return int(np.sum(mix(found ^ _U(0x5851F42D4C957F2D)), dtype=np.uint64).astype(np.int64)) if len(found) else 0


def _parts(texts, most: int = 1 << 20) -> Iterator[tuple[int, list]]:
    """Runs of texts of about a megabyte, with the index of the first."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        if i > start and size + len(x or "") > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(x or "")
    if start < len(texts):
        yield start, texts[start:]


def node_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (null for an empty set) of every row."""

    @F.pandas_udf("n_shingles long, node long")
    def names(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in releasing(batches):
            found = [(len(x), name_of(x) if len(x) else None) for _, part in _parts(list(texts)) for x in sets_of(part)]
            yield pd.DataFrame({"n_shingles": [n for n, _ in found], "node": pd.array([x for _, x in found], "Int64")})

    x = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), names(F.col("text")).alias("s"))
    return x.select("doc_id", "text_hash", "s.n_shingles", "s.node")


# --- hashes by range --------------------------------------------------------------------------------------------------


def _range_of(values: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each of some 64-bit hashes, by their upper halves."""
    return ((values.astype(np.uint64) >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int32)


def _by_range(part: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
    """A row for each range, with the columns of its entries one after the other."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    groups = np.split(order, cuts) if len(order) else []
    return pd.DataFrame({"part": np.array([part[g[0]] for g in groups], np.int32), **{f"c{i}": [c[g].tobytes() for g in groups] for i, c in enumerate(columns)}})


def _held(pairs: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owners, hashes) of about HELD of the hashes of (owner, hashes), each owner once in what is held."""
    hashes, owners, size = [], {}, 0
    for owner, found in pairs:
        if owner in owners or not len(found):
            continue
        owners[owner] = len(found)
        hashes.append(found)
        size += len(found)
        if size >= HELD:
            yield np.repeat(np.fromiter(owners, np.int64), list(owners.values())), np.concatenate(hashes)
            hashes, owners, size = [], {}, 0
    if size:
        yield np.repeat(np.fromiter(owners, np.int64), list(owners.values())), np.concatenate(hashes)


def _column(frame: pd.DataFrame, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in frame[name]])


# --- step 1: sets that can have a partner -----------------------------------------------------------------------------


#: Bits of a set's name that stand for it while shingles are counted; the rest of 64 are of the shingle within its range.
OWNER = 40


def owner_of(node):
    """A node, as a column, by the bits that stand for it in shared_shingles."""
    return node.bitwiseAND(F.lit((1 << OWNER) - 1).cast("long"))


def shared_shingles(docs: DataFrame, hash_ranges: int, set_ranges: int) -> DataFrame:
    """owner, shared: for each set with any, how many of its shingles some other set has (or more, never fewer).

    A shingle travels as one number of 64 bits, the last ones of its set's name. A task counts a range of shingles, and
    gives one row for each range of sets; another sums up a range of sets."""
    mask = _U((1 << OWNER) - 1)

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each():
            for frame in releasing(frames):
                for _, part in _parts(list(frame["text"])):
                    yield from ((name_of(found), mix(found)) for found in sets_of(part) if len(found))

        for owners, hashes in _held(each()):
            yield _by_range(_range_of(hashes, hash_ranges), hashes << _U(OWNER) | owners.astype(np.uint64) & mask)

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        found = np.unique(_column(frame, "c0", np.uint64))
        hashes = found >> _U(OWNER)
        alike = hashes[1:] == hashes[:-1]
        owners, n = np.unique(found[np.append(alike, False) | np.append(False, alike)] & mask, return_counts=True)
        return _by_range(_range_of(owners << _U(64 - OWNER), set_ranges), owners.astype(np.int64), n.astype(np.uint32))

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        owners, index = np.unique(_column(frame, "c0", np.int64), return_inverse=True)
        return pd.DataFrame({"owner": owners, "shared": np.bincount(index, _column(frame, "c1", np.uint32), len(owners)).astype(np.int64)})

    spread_out = docs.select("text").mapInPandas(spread, "part int, c0 binary")
    counted = spread_out.groupBy("part").applyInPandas(count, "part int, c0 binary, c1 binary")
    return counted.groupBy("part").applyInPandas(total, "owner long, shared long")


# --- step 2: signatures -----------------------------------------------------------------------------------------------


def _parts_for(low: int, differ: int) -> int:
    """First-level parts so many that a set of size `low` is likely to withstand so many differing shingles."""

    def enough(parts: int) -> bool:
        full = 1 - np.exp(-low / (CELLS * parts))
        return parts * (2 - 2 * (1 - full) ** 3 - 3 * full * (1 - full) ** 2) >= 1.12 * differ + 3

    few, many = 0, 2 * differ + 8
    while many - few > 1:
        few, many = ((few + many) // 2, many) if not enough((few + many) // 2) else (few, (few + many) // 2)
    return many


def bands(largest: int) -> list[tuple[int, int, int, int]]:
    """(smallest size, largest size, most differing shingles, first-level parts) of each band that has linked sets, as
    far as sets of size `largest` need them.

    The smaller of two linked sets decides on the band: its size is below the next band's smallest."""
    low = _NEXT[0]
    while low <= largest:
        after = max(low + 1, int(np.ceil(STEP * low)))
        high = 100 * (after - 1) // SIMILARITY
        differ = (100 - SIMILARITY) * (after - 1 + high) // (100 + SIMILARITY)
        if differ:
            _BANDS.append((low, high, differ, _parts_for(low, differ)))
        low = _NEXT[0] = after
    return _BANDS


_BANDS: list[tuple[int, int, int, int]] = []
_NEXT = [1]


def signatures(found: np.ndarray) -> np.ndarray:
    """All signatures of a set, over the bands of its size."""
    size, out = len(found), []
    for low, high, differ, parts in bands(size):
        if low > size:
            break
        if size > high:
            continue
        seed = _U(low * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        spread = mix(found ^ seed)
        cell = ((spread >> _U(32)) * _U(parts * CELLS) >> _U(32)).astype(np.int64)
        content = np.zeros(parts * CELLS, np.uint64)
        np.add.at(content, cell, mix(spread + _U(0x2545F4914F6CDD1D)))
        filled = np.bincount(cell, minlength=parts * CELLS).reshape(parts, CELLS) > 0
        content = mix(content.reshape(parts, CELLS) + np.arange(CELLS, dtype=np.uint64) + np.arange(parts, dtype=np.uint64)[:, None] * _U(CELLS)) * filled
        for left_out in range(CELLS):  # the subsets of all cells but one
            rest = [c for c in range(CELLS) if c != left_out]
            some = filled[:, rest].any(axis=1)
            subset = content[:, rest].sum(axis=1, dtype=np.uint64)
            numbers = np.arange(parts, dtype=np.uint64) * _U(CELLS) + _U(left_out)
            out.append(mix(subset + mix(numbers + seed))[some])
        if np.minimum(filled.sum(axis=1), 2).sum() <= differ:
            out.append(mix(spread + _U(0x632BE59BD9B4E019)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sharing(sets: DataFrame, hash_ranges: int, set_ranges: int) -> DataFrame:
    """(pivot, node): for each signature that several sets share, the smallest node and each of the others.

    A task finds the pairs of a range of signatures, and gives one row for each range of pairs; another makes them distinct."""

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each():
            for frame in releasing(frames):
                for node, data in zip(frame["node"], frame["found"], strict=True):
                    yield int(node), signatures(np.frombuffer(data, np.uint64))

        for owners, hashes in _held(each()):
            yield _by_range(_range_of(hashes, hash_ranges), owners, hashes.astype(np.uint32))

    def stars(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, index = np.unique(_column(frame, "c0", np.int64), return_inverse=True)
        found = np.unique(_column(frame, "c1", np.uint32).astype(np.uint64) << _U(32) | index.astype(np.uint64))
        hashes, index = found >> _U(32), (found & _U(0xFFFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        pivot = np.repeat(index[starts], np.diff(np.append(starts, len(found))))  # indices are in the order of nodes
        other = pivot != index
        pairs = np.unique(pivot[other] << 32 | index[other])
        pivots, others = nodes[pairs >> 32], nodes[pairs & 0xFFFFFFFF]
        return _by_range(_range_of(mix(pivots.astype(np.uint64) ^ mix(others.astype(np.uint64))), set_ranges), pivots, others)

    def distinct(frame: pd.DataFrame) -> pd.DataFrame:
        pairs = np.unique(np.stack([_column(frame, c, np.int64) for c in ("c0", "c1")], axis=1), axis=0)
        return pd.DataFrame({"pivot": pairs[:, 0], "node": pairs[:, 1]})

    spread_out = sets.select("node", "found").mapInPandas(spread, "part int, c0 binary, c1 binary")
    found = spread_out.groupBy("part").applyInPandas(stars, "part int, c0 binary, c1 binary")
    return found.groupBy("part").applyInPandas(distinct, "pivot long, node long")


# --- step 3: exact comparison -----------------------------------------------------------------------------------------


def sketch(found: np.ndarray) -> bytes:
    """A bitmap of the set, of 4 to 8 bits a shingle."""
    flags = np.zeros(max(64, 1 << (4 * len(found) - 1).bit_length()), bool)
    flags[(mix(found ^ _U(0x3C6EF372FE94F82B)) & _U(len(flags) - 1)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def most_shared(x: bytes, n_x: int, y: bytes, n_y: int) -> int:
    """A bound on the shingles that two sets share: a bit that only one has is a shingle that the other lacks."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a = np.bitwise_or.reduce(a.reshape(-1, len(b)), axis=0)
    elif len(b) > len(a):
        b = np.bitwise_or.reduce(b.reshape(-1, len(a)), axis=0)
    return min(n_x - int(np.bitwise_count(a & ~b).sum()), n_y - int(np.bitwise_count(b & ~a).sum()))


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b): a, b, n_a, n_b, shared, exact. shared is the number of shingles that both have, where a bound on
    it by bitmaps, which are much smaller than the sets, leaves a link possible; else it is that bound."""

    def bounded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            most = [most_shared(x, n, y, m) for x, n, y, m in zip(frame["bits_a"], frame["n_a"], frame["bits_b"], frame["n_b"], strict=True)]
            yield frame[["a", "b", "n_a", "n_b"]].assign(shared=np.array(most, np.int64))

    rough = materialize(with_both(pairs.select("a", "b").distinct(), sets, "n", "bits").mapInPandas(bounded, _PAIR), "rough")
    exact = exactly(rough.filter(LINKED).drop("shared"), sets)
    return exact.withColumn("exact", F.lit(True)).unionByName(rough.filter(f"not ({LINKED})").withColumn("exact", F.lit(False)))


def exactly(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, n_a, n_b) with shared, the number of shingles that both have."""

    def shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(frame["found_a"], frame["found_b"], strict=True)]
            yield frame[["a", "b", "n_a", "n_b"]].assign(shared=np.array(n, np.int64))

    return with_both(pairs, sets, "found").mapInPandas(shared, _PAIR)


def with_both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


_PAIR = "a long, b long, n_a long, n_b long, shared long"
LINKED = f"100 * shared >= {SIMILARITY} * (n_a + n_b - shared)"


def joined(roots: DataFrame | None, new: DataFrame) -> DataFrame:
    """(id, root) after new links (a, b): only links between components are followed, by their roots."""
    if roots is None:
        return connected(new)
    a, b = roots.select(F.col("id").alias("a"), F.col("root").alias("root_a")), roots.select(F.col("id").alias("b"), F.col("root").alias("root_b"))
    between = new.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a <> b")
    after = materialize(connected(between), "joined")
    kept = roots.join(after.select(F.col("id").alias("root"), F.col("root").alias("r")), "root", "left").select("id", F.coalesce("r", "root").alias("root"))
    return kept.unionByName(after.join(roots.select("id"), "id", "left_anti"))


def links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is connected: not all pairs, but whatever is linked is joined by them."""
    alike = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * SIMILARITY
    count, size = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    clusters = materialize(sharing(sets, ranges(EACH * size, RANGE), ranges(count, SETS)), "clusters")
    star = clusters.select(F.col("pivot").alias("cluster"), "node").unionByName(clusters.select(F.col("pivot").alias("cluster"), F.col("pivot").alias("node")).distinct())
    star = materialize(star.join(sets.select("node", "n"), "node").withColumn("root", F.col("node")).withColumn("pivot", F.col("cluster")), "members")
    done = found = roots = None
    for _ in range(STARS):
        pivots = star.filter("node = pivot").select("cluster", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"))
        pairs = star.filter("node <> pivot").join(pivots, "cluster").filter(alike(F.col("n"), F.col("n_a")) & (F.col("root") != F.col("root_a")))
        compared = materialize(compare(pairs.select("a", F.col("node").alias("b")), sets), "compared")
        done = compared if done is None else done.unionByName(compared)
        new = compared.filter(LINKED).select("a", "b")
        found = new if found is None else found.unionByName(new)
        roots = materialize(joined(roots, new), "roots")
        star = regrouped(star.filter("node <> pivot"), roots)  # the pivots have been compared with all others there
    # the most likely link of each two components in each two blocks first: what these join has no more to be compared
    likely = materialize(exactly(materialize(within_clusters(star, done, sets, True), "likely"), sets).filter(LINKED).select("a", "b"), "new")
    star = regrouped(star, materialize(joined(roots, likely), "roots"))
    rest = exactly(materialize(within_clusters(star, done, sets, False), "maybe"), sets).filter(LINKED).select("a", "b")
    return found.unionByName(likely).unionByName(rest)


def regrouped(star: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of the clusters that are not one component yet, with their components and the next pivot, as a table: they
    are read several times, and each time would join anew."""
    star = star.drop("pivot", "root").join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    star = materialize(star, "members")
    open_ = star.groupBy("cluster").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("node").alias("pivot")).filter("x <> y")
    return materialize(star.join(open_.select("cluster", "pivot"), "cluster"), "open")


def ranges(entries: int, each: int) -> int:
    return max(1, -(-entries // each))


_BLOCK = np.dtype([("node", np.int64), ("root", np.int64), ("n", np.int64), ("least", np.float64), ("most", np.float64), ("size", np.int64)])


def within_clusters(star: DataFrame, done: DataFrame, sets: DataFrame, best: bool) -> DataFrame:
    """Distinct pairs (a, b, n_a, n_b) of the members of a cluster that may be linked: in different components, of like
    sizes, within reach by the distances to the cluster's first pivot, and by the bound from their bitmaps. With `best` only
    the most likely one of each two components in each two blocks.

    Members are dealt into blocks of about MEMBERS, those of a large component into blocks of their own. A block is one
    row, and a task compares two blocks, unless both are of one component: what it gives are the pairs that pass and not
    all pairs, and no cluster is one task's work."""
    away = 1 - F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    known = done.select(F.col("a").alias("cluster"), F.col("b").alias("node"), away.alias("least"), F.when(F.col("exact"), away).otherwise(1.0).alias("most"))
    known = known.groupBy("cluster", "node").agg(F.max("least").alias("least"), F.min("most").alias("most"))
    parts = star.groupBy("cluster", "root").agg(F.count("*").alias("m")).withColumn("own", F.col("m") >= MEMBERS)
    pools = parts.filter("not own").groupBy("cluster").agg(F.sum("m").alias("pool"))
    parts = parts.join(pools, "cluster", "left").select("cluster", "root", "own", F.ceil(F.when(F.col("own"), F.col("m")).otherwise(F.col("pool")) / MEMBERS).alias("blocks"))
    x = star.select("cluster", "node", "n", "root").join(known, ["cluster", "node"], "left").join(parts, ["cluster", "root"]).join(sets.select("node", "bits"), "node")
    x = x.withColumn("least", F.coalesce("least", F.lit(0.0))).withColumn("most", F.coalesce("most", F.lit(1.0)))
    x = x.withColumn("own", F.when(F.col("own"), F.col("root"))).withColumn("block", F.xxhash64("cluster", F.coalesce("own", F.lit(0)), F.pmod(F.xxhash64("node"), F.col("blocks"))))

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        rows = np.zeros(len(frame), _BLOCK)
        for c in ("node", "root", "n", "least", "most"):
            rows[c] = frame[c]
        rows["size"] = [len(b) for b in frame["bits"]]
        return pd.DataFrame({"cluster": frame["cluster"].iloc[:1], "block": frame["block"].iloc[:1], "own": frame["own"].iloc[:1].astype("Int64"), "members": [rows.tobytes()], "bits": [b"".join(frame["bits"])]})

    columns = ("cluster", "node", "n", "root", "least", "most", "bits", "own", "block")
    packed = x.select(*columns).groupBy("cluster", "block").applyInPandas(gather, "cluster long, block long, own long, members binary, bits binary")
    packed = materialize(packed, "blocks")
    side = lambda s, *more: packed.select("cluster", F.col("block").alias(f"block_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in more])
    both = side("i", "own").join(side("j", "own"), "cluster").filter("block_i <= block_j and not (own_i <=> own_j and own_i is not null)").drop("own_i", "own_j")
    both = both.join(side("i", "members", "bits"), ["cluster", "block_i"]).join(side("j", "members", "bits"), ["cluster", "block_j"])

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [p for r in frame.itertuples() for p in _possible(r.members_i, r.bits_i, r.members_j, r.bits_j, r.block_i == r.block_j, best)]
            yield pd.DataFrame(out, columns=["a", "b", "n_a", "n_b"], dtype=np.int64)

    both = both.repartition(shuffle_partitions(star.sparkSession), "block_i", "block_j")  # few bytes, but much work
    return both.mapInPandas(pairs, "a long, b long, n_a long, n_b long").distinct()


def _possible(left: bytes, bits_left: bytes, right: bytes, bits_right: bytes, same: bool, best: bool) -> list[tuple[int, int, int, int]]:
    """The pairs of two blocks' members that may be linked, the smaller node first; with `best` the most likely one for each
    two components."""
    x, y, reach = np.frombuffer(left, _BLOCK), np.frombuffer(right, _BLOCK), 1 - SIMILARITY / 100 + 1e-9
    a, b = x[:, None], y[None]
    some = (a["root"] != b["root"]) & (100 * np.minimum(a["n"], b["n"]) >= SIMILARITY * np.maximum(a["n"], b["n"])) & (a["least"] - b["most"] <= reach) & (b["least"] - a["most"] <= reach)
    if same:
        some &= a["node"] < b["node"]
    at_x, at_y = np.append(0, np.cumsum(x["size"])), np.append(0, np.cumsum(y["size"]))
    folded: dict[tuple[int, int], np.ndarray] = {}  # the right bitmaps of one size, at a size

    def right_bits(size: int, rows: np.ndarray, at: int) -> np.ndarray:
        if (size, at) not in folded:
            bits = np.stack([np.frombuffer(bits_right[at_y[q] : at_y[q + 1]], np.uint64) for q in rows])
            folded[size, at] = np.bitwise_or.reduce(bits.reshape(len(rows), -1, at), axis=1) if at < bits.shape[1] else bits
        return folded[size, at]

    sizes = [(int(size), np.flatnonzero(y["size"] == size)) for size in np.unique(y["size"])]
    out = []
    for p in np.flatnonzero(some.any(axis=1)):
        own, n = np.frombuffer(bits_left[at_x[p] : at_x[p + 1]], np.uint64), int(x["n"][p])
        for size, rows in sizes:
            if not some[p, rows].any():
                continue
            at = min(len(own), size // 8)
            theirs, mine = right_bits(size, rows, at), np.bitwise_or.reduce(own.reshape(-1, at), axis=0)
            shared = np.minimum(n - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64), y["n"][rows] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64))
            good = some[p, rows] & (100 * shared >= SIMILARITY * (n + y["n"][rows] - shared))
            out += [(-shared[i] / (n + int(y["n"][rows[i]]) - shared[i]), int(p), int(rows[i])) for i in np.flatnonzero(good)]
    found: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for _, p, q in sorted(out):
        (node, n), (far, m) = sorted([(int(x["node"][p]), int(x["n"][p])), (int(y["node"][q]), int(y["n"][q]))])
        key = tuple(sorted((int(x["root"][p]), int(y["root"][q])))) if best else (node, far)
        found.setdefault(key, (node, far, n, m))
    return list(found.values())


def rooted(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, root, component_id of every row of docs (doc_id, text): root names its component
    and is null where the set is empty or the doc_id null."""
    with small_batches(docs.sparkSession):
        return _rooted(docs)


def _rooted(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = materialize(node_rows(docs), "rows")
    known = rows.filter("doc_id is not null and node is not null")
    nodes = materialize(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")), "nodes")
    count, size = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shared = shared_shingles(docs.filter("doc_id is not null"), ranges(size, RANGE), ranges(count, SETS))
    able = materialize(nodes.withColumn("owner", owner_of(F.col("node"))).join(shared, "owner").filter(f"100 * shared >= {SIMILARITY} * n").select("doc_id"), "able")

    def sets_again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in releasing(frames):
            for _, part in _parts(list(frame["text"])):
                found = [x for x in sets_of(part) if len(x)]
                yield pd.DataFrame({"node": np.array([name_of(x) for x in found], np.int64), "n": np.array([len(x) for x in found], np.int64), "bits": [sketch(x) for x in found], "found": [x.tobytes() for x in found]})

    with scratch(docs.sparkSession):
        sets = docs.join(able, "doc_id", "left_semi").select("text").mapInPandas(sets_again, "node long, n long, bits binary, found binary")
        sets = materialize(sets.dropDuplicates(["node"]), "sets")
        roots = materialize(connected(links(sets)), "roots", keep=True)
    nodes = nodes.join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    nodes = nodes.join(least, "root").select("node", "root", "component_id")
    known = F.col("doc_id").isNotNull()
    return rows.join(nodes, "node", "left").select("doc_id", "text_hash", "n_shingles", F.when(known, F.col("root")).alias("root"), F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included. A null text is empty; an empty set
    links with nothing. A row with a null doc_id links with nothing either: its component_id is null. Rows that repeat a
    doc_id have a set each, and equal rows are in one component. An empty table gives no rows. Other columns are ignored."""
    return rooted(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs from each component, with its columns: that of the smallest doc_id, of rows that share it the one
    with the least hash of its text. Rows with an empty set or a null doc_id are linked with nothing and all stay."""
    stay = rooted(docs).filter("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select(F.col("k.doc_id").alias("_doc"), F.col("k.text_hash").alias("_hash"))
    empty = F.coalesce(~F.col("text").rlike(WORD), F.lit(True)) | F.col("doc_id").isNull()
    rows = docs.filter(~empty).select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_hash"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    first = F.row_number().over(Window.partitionBy("_doc", "_hash").orderBy("_doc"))  # equal rows: any of them
    rows = rows.join(materialize(stay, "stay"), ["_doc", "_hash"]).withColumn("_n", first).filter("_n = 1").select("row.*")
    return rows.unionByName(docs.filter(empty))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
