"""Operator 10: best-fit packing of tokenized documents after Martello-Toth dominance reduction.

Pieces of equal length are interchangeable, so the packing is worked out on the histogram of lengths, which has at most
`capacity` entries whatever the size of the corpus. Only that histogram reaches the driver. The plan's slots are then
dealt to the pieces by their rank within a length; ranks come from counts by (length, part), so that a length which a
third of all pieces share is no single task's work."""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, releasing, small_batches, table

CAPACITY = 2048
#: Distinct words whose ids a worker remembers, and the longest that it does: this bounds what it holds.
REMEMBERED, REMEMBERED_CHARS = 200_000, 32
#: Pieces of a length in a part that is ranked by itself: a length has as many parts as that takes.
RANKED = 2_000
#: Code points of an odd text that are tokenized at once, where it has places to cut.
CHUNK = 1 << 15
_ODD_SPACE = [chr(c) for c in (*range(0x09, 0x0A), *range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Fixed value: how a byte-level BPE of this kind cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUNS = ("  ", " \n", "\n ", "\n\n\n")
_CUT = re.compile(r"(?<=\S)[ \n]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Ids(dict):
    """Little-endian 32-bit ids of a word with the white space before it.

    Words not met lately are merged by tiktoken from the tokenizer file's own vocabulary, which is several times faster
    than calling the tokenizer for each; that needs a byte-level BPE whose ids follow its merges, and else the tokenizer
    itself is called. The tokenizer is loaded when it is first needed."""

    def __init__(self, path: str):
        self.path = path
        self.merged, added = _merger(path)
        self.special = [t["content"] for t in added]
        # a text is cut before white space only where no special token can reach over it
        self.cuttable = self.merged is not None and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")) and not any(c.isspace() for x in self.special for c in x)

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str | tuple[str]) -> bytes:
        """The key of a text's first word, which has no white space before it, is a tuple, which no other word is."""
        text = word[0] if isinstance(word, tuple) else word if word[:1] == "\n" else f" {word}"
        ids = np.array(self.merged(text), "<u4").tobytes() if self.merged else self.plain(text)
        if len(text) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        """The ids of a whole text. A byte-level BPE never joins what lies on both sides of a space or line end, so
        words are looked up one by one; a text with runs of white space, which form tokens of their own, is merged in
        chunks, and one with other white space, NUL or a special token's string goes to the tokenizer in chunks."""
        if not text:
            return b""
        if self.merged is None:
            return self.plain(text)
        if "\0" in text or any(c in text for c in _ODD_SPACE) or any(s in text for s in self.special):
            return b"".join(map(self.plain, chunks(text) if self.cuttable else [text]))
        if text[0] in " \n" or text[-1] in " \n" or any(r in text for r in _RUNS):
            return b"".join(np.array(self.merged(x), "<u4").tobytes() for x in chunks(text))
        first, *words = text.replace("\n", " \n").split(" ")
        return self[first,] + b"".join(map(self.__getitem__, words))


def chunks(text: str, most: int = CHUNK) -> Iterator[str]:
    """A text in parts of about `most` code points, cut before a space or line end that follows something else: what a
    byte-level BPE makes of white space begins there, whatever stands before it."""
    at = 0
    while len(text) - at > most:
        end = at + most
        found = _CUT.search(text, end)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def _merger(path: str):
    """A function from text to ids over the file's vocabulary, or None where that would not be the same; the added tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    return _merged(spec), spec.get("added_tokens", [])


def _merged(spec: dict):
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    if spec.get("normalizer") or any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges")):
        return None
    plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]  # bytes shown as themselves
    shown = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    ids = [model["vocab"].get(m.replace(" ", "")) for m in merges]
    if None in ids or ids != sorted(ids) or len(ids) + 256 > len(model["vocab"]):
        return None
    added = {t["content"] for t in spec.get("added_tokens", [])}
    import tiktoken

    ranks = {bytes(shown[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@functools.cache
def _ids(path: str) -> _Ids:
    """One for each worker process, which runs many tasks."""
    return _Ids(path)


def tokenize(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id (0 and missing, if null), piece, start, length, ids_crc32 of every piece: a document's ids, then id 0, cut only if longer than
    `capacity` into pieces of that length, the first of which may be shorter."""
    path = tokenizer or default_tokenizer()

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _ids(path)
        for frame in releasing(frames):
            rows = []
            for doc, missing, text in zip(frame["doc_id"], frame["missing"], frame["text"], strict=True):
                data = ids.of(text or "") + b"\0\0\0\0"
                n, start, piece = len(data) // 4, 0, 0
                while start < n:
                    length = (n - 1) % capacity + 1 if start == 0 else capacity
                    rows.append((doc, missing, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
                    start, piece = start + length, piece + 1
            yield pd.DataFrame(rows, columns=["doc_id", "missing", "piece", "start", "length", "ids_crc32"])

    x = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("missing"), F.col("text"))
    return x.mapInPandas(pieces, "doc_id long, missing boolean, piece int, start long, length long, ids_crc32 long")


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths in it, how many such bins), for so many pieces of each length.

    Reduction, from the longest piece j down: a bin with j is fixed where it dominates every other bin with j, that is,
    where whatever else could stand beside j can be split among the bin's pieces, each part no longer than its piece.
    This holds for j alone if nothing fits beside it; for j and k, the longest that fits, if no two or more pieces that
    fit beside j are together longer than k; and for j, k and b, the longest that fits beside both, if no three fit
    beside j and no two that do are both longer than b and together longer than k. What is left is packed by best fit
    decreasing."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        left[length] += n
    bins = reduced(left, capacity)
    groups: dict[int, Counter] = defaultdict(Counter)  # by room left: bins so filled
    rooms = np.zeros(capacity + 1, np.int64)
    for j in range(capacity, 0, -1):
        while left[j] > 0:
            fit = np.flatnonzero(rooms[j:] > 0)
            room = int(fit[0]) + j if len(fit) else capacity
            if len(fit):
                filled, there = next(iter(groups[room].items()))
            else:
                filled, there = (), int(left[j])
            each = 1 if len(fit) else min(room // j, int(left[j]))
            n = min(there, int(left[j]) // each)
            if len(fit):
                groups[room][filled] -= n
                if not groups[room][filled]:
                    del groups[room][filled]
                rooms[room] -= n
            groups[room - each * j][filled + (j,) * each] += n
            rooms[room - each * j] += n
            left[j] -= n * each
    return bins + [(filled, n) for room in sorted(groups) for filled, n in groups[room].items()]


def reduced(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The bins that dominance fixes, as plan() gives them; their pieces are taken from `left`, the number of each length."""
    bins: list[tuple[tuple[int, ...], int]] = []
    for j in range(capacity, 0, -1):
        while left[j] > 0:
            left[j] -= 1
            beside = _dominant(left, capacity - j)
            left[j] += 1
            if beside is None:
                break
            filled = (j, *beside)
            n = min(int(left[x]) // m for x, m in Counter(filled).items())
            bins.append((filled, n))
            for x in filled:
                left[x] -= n
    return bins


def _dominant(left: np.ndarray, room: int) -> tuple[int, ...] | None:
    """What to put beside a piece that leaves `room`, so that no other choice can be better; None if that is not sure."""
    have = np.flatnonzero(left[: room + 1] > 0)  # the lengths that fit, from the shortest
    if len(have) == 0:
        return ()
    k = int(have[-1])
    if k == room:
        return (k,)
    # for each length the longest that fits with it, another piece of the same length only if there is one
    partner = np.searchsorted(have, room - have, side="right") - 1
    partner -= (partner == np.arange(len(have))) & (left[have] < 2)
    some = partner >= 0
    if not some.any():
        return (k,)
    x, y = have[some], have[partner[some]]
    if (x + y).max() <= k and _most(have, left, room) <= k:
        return (k,)
    shortest = np.repeat(have[:3], np.minimum(left[have[:3]], 3))[:3]
    if len(shortest) == 3 and shortest.sum() <= room:
        return None
    beside = have[: np.searchsorted(have, room - k, side="right")]
    beside = beside[(beside != k) | (left[beside] > 1)]
    if len(beside) == 0:
        return None
    b = int(beside[-1])
    return (k, b) if not ((np.minimum(x, y) > b) & (x + y > k)).any() else None


def _most(have: np.ndarray, left: np.ndarray, room: int) -> int:
    """The greatest sum of two or more pieces that is not above room; the bits of a number stand for sums."""
    one, more, mask = 1, 0, (1 << (room + 1)) - 1  # sums of at most one piece (and none), and of two and more
    for length in map(int, have):
        for _ in range(min(int(left[length]), room // length)):
            more = (more | more << length | (one & ~1) << length) & mask
            one |= 1 << length
    return more.bit_length() - 1


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every row of docs (doc_id, text) with its sequence and its offset there.

    A null text is empty, and an empty text is one piece of the single id 0. Rows that repeat are packed each. A null
    doc_id is kept as null. An empty table gives no rows. Other columns are ignored."""
    spark = docs.sparkSession
    with small_batches(spark):
        pieces = materialize(tokenize(docs, tokenizer, capacity), "pieces")
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    parts = F.create_map(*[F.lit(x) for length, n in sorted(lengths.items()) if n > RANKED for x in (length, -(-n // RANKED))]) if any(n > RANKED for n in lengths.values()) else F.create_map().cast("map<bigint,int>")
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.coalesce(F.element_at(parts, F.col("length")), F.lit(1))).cast("int"))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    first: dict[int, list[int]] = defaultdict(list)
    sequence: dict[int, list[int]] = defaultdict(list)
    offset: dict[int, list[int]] = defaultdict(list)
    used: Counter = Counter()
    base = 0
    for filled, n in plan(lengths, capacity):
        at = 0
        for length in filled:
            first[length].append(used[length])
            sequence[length].append(base)
            offset[length].append(at)
            used[length] += n
            at += length
        base += n
    slots = {length: tuple(np.array(x[length], np.int64) for x in (first, sequence, offset)) for length in first}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rank, lengths_here = frame.pop("rank").to_numpy(), frame["length"].to_numpy()
            out_sequence, out_offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            order = np.argsort(lengths_here, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(lengths_here[order])) + 1) if len(order) else []:
                starts, sequences, offsets = slots[int(lengths_here[part[0]])]
                i = np.searchsorted(starts, rank[part], side="right") - 1
                out_sequence[part], out_offset[part] = sequences[i] + rank[part] - starts[i], offsets[i]
            yield frame.assign(sequence_id=out_sequence, offset=out_offset)

    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "missing", "piece", "start", "ids_crc32"))
    ranked = pieces.withColumn("inside", inside).join(before.drop("n"), ["length", "part"])
    ranked = ranked.select("doc_id", "missing", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside") - 1).alias("rank"))
    placed = ranked.mapInPandas(place, "doc_id long, missing boolean, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("doc_id", F.when(~F.col("missing"), F.col("doc_id"))).drop("missing")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
