"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import glob
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a worker holds at once; a longer text comes alone.
CHUNK_BYTES = 8 << 20

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@lru_cache(maxsize=1)
def one_blas_thread() -> None:
    """Keep numpy's own OpenBLAS to one thread: every core has a task already, and the matrices are small. Without that library nothing is done."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__) + ".libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(wanted: str, columns: list[str]) -> str:
    """`wanted`, with underscores before it until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Return to the system what this worker has freed: workers live on, and the next stage's ones count beside the memory that they keep."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most `most` bytes of text, or one row. What a task before has freed is given back first."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        if size.sum() <= most:
            yield batch
            continue
        start, total = 0, 0
        for i, n in enumerate(size):
            if total + n > most and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 of each text; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def bounded(rows: DataFrame, by: str, most: int, most_bytes: int) -> DataFrame:
    """At most `most` rows (doc_id, text, ...) of each value of `by`, and at most `most_bytes` of their texts, always the same ones: in the order of a hash of
    the id, then of the text. A text of more than a sixteenth of the bytes is passed over. The rows are few already: this makes the bound hold where ids repeat or texts are long."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    w = Window.partitionBy(by).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text")
    n, total = free_name("_n", rows.columns), free_name("_total", rows.columns)
    kept = rows.where(size * 16 <= most_bytes).withColumn(n, F.row_number().over(w)).withColumn(total, F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return kept.where((F.col(n) <= most) & (F.col(total) <= most_bytes)).drop(n, total)


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """True where crc32 of the id as text leaves no remainder."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0


def held_out_of(ids: list, folds: int) -> np.ndarray:
    """As `held_out`, in a worker; a null id is held out of training."""
    return np.array([i is None or zlib.crc32(str(i).encode()) % folds == 0 for i in ids], dtype=bool)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def with_text(batch: pa.RecordBatch, text: pa.Array) -> pa.RecordBatch:
    """The batch with another text, and n_chars to match where there is such a column."""
    cols = []
    for f, c in zip(batch.schema, batch.columns, strict=True):
        if f.name == "text":
            c = text.cast(f.type)
        elif f.name == "n_chars":
            c = pc.if_else(pc.is_valid(text), pc.utf8_length(text).cast(f.type), c)
        cols.append(c)
    return pa.RecordBatch.from_arrays(cols, schema=batch.schema)
