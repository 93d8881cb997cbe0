"""What the corpus operators share: checkpoint tables, batch slicing, vectorised words.

Words are taken from UTF-8 bytes with NumPy over a whole Arrow slice: separators are a
256-entry table, so a word never costs a Python object.  A word is named by a 64-bit hash;
at V distinct words the chance that any two share one is about V*V / 2**65.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Separators of `[^\x20\x09-\x0D]+`, and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
SPACE_SEP = np.zeros(256, bool)
SPACE_SEP[[0x20, *range(0x09, 0x0E)]] = True
ALNUM_SEP = np.zeros(256, bool)
ALNUM_SEP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: The same class for bytes that are not lower-cased yet.
LETTER_SEP = ALNUM_SEP.copy()
LETTER_SEP[0x41:0x5B] = False
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[0x41:0x5B] += 0x20

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where spark.checkpoint.dir is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or f"{tempfile.gettempdir()}/junctura-checkpoints").rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by writing a table in the shared checkpoint folder and reading it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Hold an intermediate that is used again; partitions that are lost with an executor are made again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


FILTER_WORDS = 1 << 17


def flagged(rows: DataFrame, keys: list[str], wanted: DataFrame, flag: str = "__jx_maybe") -> DataFrame:
    """`rows` with a flag that is true wherever its keys are among `wanted`, and seldom elsewhere.

    The keys' bitmap, at most FILTER_WORDS rows of 64 bits, is broadcast.  It saves shuffling
    texts that a join would not find; where it is full, all rows are flagged.
    """
    word, bit = F.pmod(F.xxhash64(*keys), F.lit(FILTER_WORDS)).cast("int"), F.expr(f"cast(pmod(xxhash64({', '.join(keys)}, 1), 64) as int)")
    mask = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(keys)}, 1), 64) as int))")
    bits = wanted.groupBy(word.alias("__jx_word")).agg(F.bit_or(mask).alias("__jx_bits"))
    found = rows.withColumns({"__jx_word": word, "__jx_bit": bit}).join(F.broadcast(bits), "__jx_word", "left")
    return found.withColumn(flag, F.coalesce(F.expr("getbit(__jx_bits, __jx_bit)") == 1, F.lit(False))).drop("__jx_word", "__jx_bits", "__jx_bit")


def without(rows: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """The rows whose key is not among `dropped` (one column of the same name); null keys stay.

    Only rows that the keys' bitmap flags are shuffled.
    """
    dropped = keep(dropped.select(key).filter(F.col(key).isNotNull()).distinct())
    marked = flagged(rows, [key], dropped)
    sure = marked.filter(~F.col("__jx_maybe")).select(rows.columns)
    return sure.unionByName(marked.filter("__jx_maybe").join(dropped, key, "left_anti").select(rows.columns))


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches so that a slice holds about `limit` bytes of text, or one long row.

    Yields (slice, bytes, offsets); null texts count as empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text)
        if col.null_count:
            col = col.fill_null(b"")
        col = col.cast(pa.large_binary())
        offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, min(n, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
            yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and per document the index of its first word (one more entry than documents)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    ok = ~sep[data]
    before, after = np.empty_like(ok), np.empty_like(ok)
    before[0], before[1:] = False, ok[:-1]
    after[-1], after[:-1] = False, ok[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(ok & ~before), np.flatnonzero(ok & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_LOWER_VALUE = _BYTE_VALUE[LOWER_BYTE]
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased; the same word has the same hash anywhere."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power_tables(max(hi - lo + 1, SLICE_BYTES + 1))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_LOWER_VALUE[data[lo:hi]] * up[: hi - lo], dtype=np.uint64, out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def hash_word(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total += mix64(hashes[k : len(hashes) - n + 1 + k] + np.uint64(k + 1)) * np.uint64(pow(_BASE, k + 1, 1 << 64))
    return mix64(total)
