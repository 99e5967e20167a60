"""Helpers shared by the training-data operators.

Texts travel to Python in Arrow batches; every helper works on one batch at a
time, so memory is bounded by the batch and not by the partition.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- shared storage -------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session may do without, with a new folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quillon-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, no lineage, readable by every executor. Its rows are counted as it is made."""
    shared_dir(df.sparkSession)
    df, rows = _counted(df)
    out = df.checkpoint(eager=True)
    out._rows = rows.get.get("n")
    return out


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    rows = Observation()
    return df.observe(rows, F.count(F.lit(1)).alias("n")), rows


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder for one table, which goes when the session ends."""
    path = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame, *, zstd: bool = True) -> DataFrame:
    """Like `cut`, as a compressed columnar table; for the larger intermediates."""
    spark = df.sparkSession
    path = new_folder(spark)
    df, rows = _counted(df)
    # no _SUCCESS file: the driver would start a process for it where Hadoop has no native library
    df.write.option("compression", "zstd" if zstd else "none").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder, out._rows = path, rows.get.get("n")
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that `stored` gave and that no later step reads."""
    for t in tables:
        _remove(t.sparkSession, t._folder)


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files and checkpoints of tables that nothing names any more, which else stay until the driver happens to collect its garbage."""
    release()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder's owner cleans up
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- Python in tasks --------------------------------------------------------

BATCH_BYTES, BLOCK_BYTES = 4 << 20, 1 << 18
_space = re.compile(rb"[\x20\x09-\x0D]").search


def arrow_scan(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over batches of a few MB, whatever the length of the texts; what a task took goes back to the system at its end."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(conf.get(key)).rstrip("bB")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Returns freed memory to the system: a worker outlives its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# --- texts ----------------------------------------------------------------


def utf8(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of a string column; null counts as empty."""
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for x in binary.to_pylist():
        yield x or b""


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b) if b in shown else chr(256 + extra)
        extra += b not in shown
    return out


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def crc_of(text: str) -> int:
    return zlib.crc32(text.encode())


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` rows, the same ones on every run: those of the smallest hashed key."""
    h = F.xxhash64(F.lit(17), F.col(key))
    return df.orderBy(h, F.col(key)).limit(limit)


def block_bounds(text: bytes) -> Iterator[tuple[int, int]]:
    """Consecutive parts of a text of about BLOCK_BYTES, each but the last ending after white space; a longer word is not cut."""
    i = 0
    while i < len(text):
        m = _space(text, i + BLOCK_BYTES) if i + BLOCK_BYTES < len(text) else None
        j = m.end() if m else len(text)
        yield i, j
        i = j


#: Blocks of 1024 bits of one map of hashed keys, keys of a block, bits of a key, and maps that are broadcast.
MAP_BLOCKS, KEYS_PER_BLOCK, KEY_BITS, MAPS = 1 << 18, 85, 4, 16


def with_hit(rows: DataFrame, own: str, keys: DataFrame, key: str) -> DataFrame:
    """rows with _hit: whether their hash `own` may be among those of `keys`, a checkpointed table of longs; never false for one that is.

    The keys become Bloom maps by aggregation, each of bounded size and for a range of hashes of its own, as many as keep false
    hits under one in a hundred: 16 maps of some 40 MB for 350 million keys. Beyond that every row is a hit.
    """
    n = keys.count()
    maps = max(1, -(-n // (MAP_BLOCKS * KEYS_PER_BLOCK)))
    if maps > MAPS:
        return rows.withColumn("_hit", F.lit(True))
    blocks = max(1, -(-n // (maps * KEYS_PER_BLOCK)))
    shift = lambda f, c, by: F.call_function(f, c, by.cast("int"))
    spread = lambda c: F.xxhash64(F.lit(7), c)
    place = lambda c: (F.pmod(F.shiftrightunsigned(spread(c), 40), F.lit(maps)).cast("int"), F.pmod(F.xxhash64(F.lit(8), c), F.lit(blocks)))
    bits = lambda c: [F.shiftrightunsigned(spread(c), 10 * i).bitwiseAND(1023) for i in range(KEY_BITS)]
    of, block = place(F.col(key))
    marks = keys.select(of.alias("_map"), block.alias("_block"), F.explode(F.array(*bits(F.col(key)))).alias("_bit"))
    word, mark = F.shiftright("_bit", 6), shift("shiftleft", F.lit(1).cast("long"), F.col("_bit").bitwiseAND(63))
    words = F.array(*(F.coalesce(F.bit_or(F.when(word == w, mark)), F.lit(0).cast("long")) for w in range(16)))
    built = cut(marks.groupBy("_map", "_block").agg(words.alias("_words")))
    of, block = place(F.col(own))
    out = rows.withColumns({"_of": of, "_at": block})
    for m in range(maps):
        one = built.where(F.col("_map") == m).select(F.col("_block").alias("_at"), F.lit(m).alias("_of"), F.col("_words").alias(f"_words{m}"))
        out = out.join(F.broadcast(one), ["_of", "_at"], "left")
    found = F.coalesce(*(F.col(f"_words{m}") for m in range(maps)))
    has = lambda b: shift("shiftright", F.element_at(found, (F.shiftright(b, 6) + 1).cast("int")), b.bitwiseAND(63)).bitwiseAND(1) == 1
    hit = F.coalesce(reduce(lambda a, b: a & b, map(has, bits(F.col(own)))), F.lit(False))
    return out.withColumn("_hit", hit).drop("_of", "_at", *(f"_words{m}" for m in range(maps)))


def without_listed(rows: DataFrame, gone: DataFrame, same: Column, limit: int) -> DataFrame:
    """The _row of rows (_row, _own) that no row of gone (_pair, ...) is the same as; equal rows have _own = _pair.

    While gone, a checkpointed table, is small it is broadcast; beyond that rows that surely stay are told by Bloom maps
    and are not shuffled.
    """
    if small(gone, limit):
        return rows.join(F.broadcast(gone), same, "left_anti").select("_row.*")
    marked = with_hit(rows, "_own", gone, "_pair")
    stay = marked.where(~F.col("_hit")).select("_row.*")
    return stay.unionByName(marked.where("_hit").join(gone, same, "left_anti").select("_row.*"))


# --- hashing of words and shingles ------------------------------------------

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_B, _C, _K = _U(_BASE), _U(0xD6E8FEB86659FD93), _U(0xC2B2AE3D27D4EB4F)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_CASED = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 18
LONG_WORD = 256
_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2^64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _BLOCK + 4096)
        inverse = pow(_BASE, -1, 2**64)
        _powers[:] = [np.cumprod(np.full(size, x, np.uint64)) for x in (_B, _U(inverse))]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _C
    return h ^ (h >> _U(29))


def word_bounds(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    s = np.ones(len(a) + 2, bool)
    s[1:-1] = SPACE[a]
    e = np.flatnonzero(s[1:] != s[:-1])
    return e[0::2], e[1::2]


def _word_hashes(a: np.ndarray, start: np.ndarray, end: np.ndarray, byte: np.ndarray) -> np.ndarray:
    power, inverse = _pow(len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(byte[a] * power[: len(a)], out=total[1:])
    out = mix((total[end] - total[start]) * inverse[start])
    for k in np.flatnonzero(end - start > LONG_WORD):  # structured long words can meet under a polynomial
        word = a[start[k] : end[k]].tobytes()
        out[k] = xxhash.xxh3_64_intdigest(word.lower() if byte is _BYTE else word)
    return out


def word_hashes(text: bytes, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased if asked; long texts go in blocks that end between words."""
    a, byte = np.frombuffer(text, np.uint8), _BYTE if fold else _BYTE_CASED
    start, end = word_bounds(a)
    if len(a) <= _BLOCK or not len(start):
        return _word_hashes(a, start, end, byte) if len(start) else np.empty(0, np.uint64)
    parts, i = [], 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
        lo, hi = start[i], end[j - 1]
        parts.append(_word_hashes(a[lo:hi], start[i:j] - lo, end[i:j] - lo, byte))
        i = j
    return np.concatenate(parts)


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for some hundred values quicker than a hash table."""
    if len(a) < 2:
        return a
    s = np.sort(a)
    first = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=first[1:])
    return s[first]


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of `size` words, in text order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n]
    for i in range(1, size):
        h = h * _K + words[i : n + i]
    return mix(h)


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than `size` words make one shingle, none make none."""
    w = word_hashes(text)
    if len(w) >= size:
        return distinct(windows(w, size))
    if not len(w):
        return w
    h = w[:1].copy()
    for x in w[1:]:
        h = h * _K + x
    return mix(h + _U(len(w)))


def signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64, copy=False).view(np.int64)


def small(df: DataFrame, rows: int) -> bool:
    """Whether a checkpointed or stored table has at most so many rows; as `cut` and `stored` gave it, without a job."""
    known = vars(df).get("_rows")
    return known <= rows if known is not None else df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Marks a checkpointed table for broadcast if its row count is within the bound; else it is joined by shuffle."""
    return F.broadcast(df) if small(df, rows) else df


#: A key with more than this part of all rows is hot; there are no more than its inverse of them.
HOT_SHARE, BROADCAST_ROWS = 1e-3, 100_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    """Joins left with right, a checkpointed or stored table that has each key once; a key may hold most rows of left.

    A small right is broadcast. Else the rows of hot keys are, and rows of left that found theirs go through the shuffle under a number
    that no row of right has (as do null keys), so only the other keys meet in tasks. counts (on, _n) is counted from left unless given.
    """
    if small(right, BROADCAST_ROWS):
        return left.join(F.broadcast(right), on, how)
    counts = cut(left.groupBy(*on).agg(F.count("*").alias("_n")) if counts is None else counts)
    most = max(1.0, (counts.agg(F.sum("_n")).first()[0] or 0) * HOT_SHARE)
    values = [c for c in right.columns if c not in on]
    few = right.join(F.broadcast(counts.where(F.col("_n") > most).select(*on)), on, "left_semi")
    few = cut(few.select(*on, *(F.col(c).alias("_of_hot" + c) for c in values), F.lit(True).alias("_hot")))
    rows = left.join(F.broadcast(few), on, "left")
    alone = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in on), F.coalesce("_hot", F.lit(False)))
    rows = rows.withColumn("_lot", F.when(alone, 1 + F.monotonically_increasing_id()).otherwise(F.lit(0)))
    out = rows.join(right.withColumns({"_lot": F.lit(0).cast("long"), "_cold": F.lit(True)}), [*on, "_lot"], "left")
    if how == "inner":
        out = out.where("_hot or _cold")
    out = out.withColumns({c: F.when(F.col("_hot"), F.col("_of_hot" + c)).otherwise(F.col(c)) for c in values})
    return out.select(*on, *(c for c in left.columns if c not in on), *values)


def sorted_longs(df: DataFrame, column: str) -> np.ndarray:
    """A column of a table whose size was checked, as a sorted array for a broadcast variable."""
    t = df.select(column).toArrow()
    return np.unique(t.column(0).to_numpy(zero_copy_only=False).astype(np.int64))


def among(a: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values of a are in the sorted array keys."""
    if not len(keys):
        return np.zeros(len(a), bool)
    at = np.searchsorted(keys, a)
    at[at == len(keys)] = 0
    return keys[at] == a
