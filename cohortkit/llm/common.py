"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space: words are runs of anything else
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def sha256_hex(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def crc32_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m``; NULL for a NULL id."""
    return F.crc32(id_col.cast("string")) % m


def text_span(text: Column, key: Column, max_chars: int) -> Column:
    """``text``, or of a longer one ``max_chars`` characters from a place chosen by a hash of ``key``."""
    n = F.length(text)
    start = F.pmod(F.xxhash64(F.lit("span"), key), F.greatest(n - F.lit(max_chars - 1), F.lit(1))).cast("int") + 1
    return F.when(n > max_chars, F.substring(text, start, F.lit(max_chars))).otherwise(text)


def text_batches(batches: Iterator[pa.RecordBatch], column: str,
                 max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``max_bytes`` of text (one row at least)."""
    for b in batches:
        i = b.schema.get_field_index(column)
        lens = np.zeros(b.num_rows, np.int64)
        if b.num_rows:
            col = b.column(i)
            lens = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0)).astype(np.int64)
        start = 0
        ends = np.cumsum(lens)
        while start < b.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` for each pair."""
    lens = np.asarray(lens, np.int64)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lens) - lens
    return np.repeat(np.asarray(starts, np.int64) - first, lens) + np.arange(total, dtype=np.int64)
