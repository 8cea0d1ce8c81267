"""Shared pieces: reading tables, cutting lineage in the shared folder, packing texts for numpy."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every operator here.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that numpy code handles at once.
BLOCK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes in an Arrow batch, where a row may hold a long text or two large sets.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def prepare(spark: SparkSession) -> None:
    """Give the executors this package, once a context: they need not have the repository on their path. Larger Arrow
    batches of the session come down to BATCHES, as results are computed after their operator has returned."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= int(BATCHES[rows]):
        for name, value in BATCHES.items():
            spark.conf.set(name, value)
    context = spark.sparkContext
    if getattr(context, "_ordermill_shipped", False):
        return
    import shutil

    package = Path(__file__).resolve().parent.parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='code-')}/ordermill", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._ordermill_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one in the warehouse, which a cluster shares too, only where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate")
    return context.getCheckpointDir()


_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are materialized inside go when it ends, but for those that `keep` hands on to what is around."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _remove(spark, path)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: it cuts lineage, survives lost executors, and lets
    Spark plan with its true size. The table goes with the scratch that it is made in, or when the process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    outer = _SCRATCH[: -1 if keep else None]
    if outer:
        outer[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended already; the folder is the cluster's to clean
        pass


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """What runs inside gets batches within BATCHES from Spark; the session's own settings come back after."""
    before = {name: spark.conf.get(name, None) for name in BATCHES}
    for name, value in BATCHES.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def release() -> None:
    """Give what the allocators hold of freed memory back to the system, where they can: after training on the driver, and
    after each task of a Python worker, as workers live on from stage to stage."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(batches: Iterator) -> Iterator:
    """The batches, and after the last of them release()."""
    yield from batches
    release()


def held_out(divisor: int, remainder: int):
    """crc32 of the doc_id as text has this remainder. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# --- words and shingles of whole texts as 64-bit hashes -------------------------------------------------------------

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_P_INV = _U(pow(int(_P), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each input bit moves each output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, BLOCK + (BLOCK >> 2))
        one = np.ones(1, np.uint64)
        _POWERS[:] = [np.concatenate([one, np.cumprod(np.full(n - 1, p, np.uint64))]) for p in (_P, _P_INV)]
    return _POWERS[0], _POWERS[1]


def _block_words(data: np.ndarray, starts_of_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of some bytes, and each word's first and past-the-end byte. Texts never share a word."""
    space = _SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = before[-1] = True
    before[1:-1] = space[:-1]
    before[starts_of_docs] = True
    starts = np.flatnonzero(~space & before[:-1])
    after = before[1:].copy()
    after[:-1] |= space[1:]
    ends = np.flatnonzero(~space & (after | np.append(space[1:], True))) + 1
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * power[: len(data)], out=total[1:])
    raw = (total[ends] - total[starts]) * inverse[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))), starts, ends


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, A-Z lower-cased, and each text's offsets into them (one more than texts).

    Works through blocks of about a megabyte cut at white space, so memory follows the block and not the longest text."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    block: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not block:
            return
        data = np.frombuffer(b"".join(x for _, x in block), np.uint8)
        if len(data):
            at = np.cumsum([0] + [len(x) for _, x in block])
            found, starts, _ = _block_words(data, at[:-1][at[:-1] < len(data)])
            owner = np.searchsorted(at, starts, side="right") - 1
            per = np.bincount(owner, minlength=len(block))
            np.add.at(counts, [i for i, _ in block], per[: len(block)])
            hashes.append(found)
        block.clear()
        size = 0

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > BLOCK:  # cut a long text after the last white space of the block, or the next one
                cut = max(text.rfind(c, at, at + BLOCK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if cut <= at:
                    later = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := text.find(c, at + BLOCK)) > 0]
                    cut = min(later, default=end - 1)
                end = cut + 1
            if size + end - at > BLOCK:
                flush()
            block.append((i, text[at:end]))
            size += end - at
            at = end
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; of fewer words, one of the whole run."""
    if len(words) == 0:
        return words
    width_here = min(width, len(words))
    n = len(words) - width_here + 1
    out = mix(words[:n] + _U(width_here))
    for j in range(1, width_here):
        out = mix(out * _U(0xD1342543DE82EF95) + words[j : j + n])
    return out


def as_bytes(values) -> list[bytes]:
    """Texts as UTF-8; a null is empty."""
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in values]


# --- letters ----------------------------------------------------------------------------------------------------------

_LETTERS: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """For each code point its lower case if it is a letter, or 0."""
    if not _LETTERS:
        found = np.zeros(0x110000, np.uint32)
        for c in (*range(0xD800), *range(0xE000, 0x32400)):  # the planes that hold letters
            if (s := chr(c)).isalpha():
                found[c] = ord(s.lower()[0])
        _LETTERS.append(found)
    return _LETTERS[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


#: Letters of a word's beginning that are hashed by themselves.
PREFIX = 4


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters of some texts, in lower case, and of their first PREFIX letters, as rows of two,
    and each text's offsets into them."""
    found: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    i = 0
    while i < len(texts):
        part: list[tuple[int, str]] = []
        size = 0
        if len(texts[i]) > BLOCK:
            at = 0
            while at < len(texts[i]):  # cut a very long text where no letter is, if there is such a place
                end = min(at + BLOCK, len(texts[i]))
                while at + 1 < end < len(texts[i]) and end > at + BLOCK // 2 and texts[i][end].isalpha():
                    end -= 1
                found.append(_runs(letters(texts[i][at:end]), np.array([0]))[0])
                counts[i] += len(found[-1])
                at = end
            i += 1
            continue
        while i < len(texts) and size + len(texts[i]) + 1 <= BLOCK + 1:
            part.append((i, texts[i]))
            size += len(texts[i]) + 1
            i += 1
        starts = np.cumsum([0] + [len(x) + 1 for _, x in part])
        hashes, owner = _runs(letters("\n".join(x for _, x in part)), starts[:-1])
        counts[[k for k, _ in part]] = np.bincount(owner, minlength=len(part))
        found.append(hashes)
    return (np.concatenate(found) if found else np.zeros((0, 2), np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def _runs(codes: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some = np.concatenate([[False], codes != 0, [False]])
    starts, ends = np.flatnonzero(some[1:-1] & ~some[:-2]), np.flatnonzero(some[1:-1] & ~some[2:]) + 1
    power, inverse = _powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _U(0x9FB21C651E98DF25) * power[: len(codes)], out=total[1:])
    upto = np.minimum(ends, starts + PREFIX)
    hashes = np.stack([mix((total[e] - total[starts]) * inverse[starts] + (e - starts).astype(np.uint64)) for e in (ends, upto)], axis=1)
    return hashes, np.searchsorted(starts_of_texts, starts, side="right") - 1
