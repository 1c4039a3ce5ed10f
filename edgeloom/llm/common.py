"""Shared pieces of the text operators."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Columns of the documents table.
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


#: Rows and bytes of a batch that goes to Python: whole texts are long rows.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Let no batch of texts grow beyond BATCH_ROWS and BATCH_BYTES; a smaller number of rows that the session sets stays."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """The fold of a document: crc32 of its id as text modulo ``folds``; fold 0 is held out."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def uniform(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values and the seed only, not on partitions."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, by columns of uint64."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class WordHashes(dict):
    """Word bytes to a 64-bit hash, remembered; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 100_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:  # long words would fill the memory
            self[word] = h
        return h


def held_columns(docs: DataFrame) -> list[str]:
    """The columns of documents that a table has: what a pipeline stage returns."""
    return [c for c in DOCUMENT if c in docs.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own beside those of a table, whatever those are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20):
    """Parts of a batch with about ``most`` bytes in one column, so that what is made of a part stays small."""
    rows = max(1, int(len(batch) * most / max(1, batch.column(column).nbytes)))
    for i in range(0, len(batch), rows):
        yield batch.slice(i, rows)


def give_back() -> None:
    """Return memory that this Python worker has freed to the machine: workers stay, and idle ones count too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
