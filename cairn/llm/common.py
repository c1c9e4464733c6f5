"""What several operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import dropped, large, stored

__all__ = ["SPACES", "WORD", "WORD_RE", "Numbering", "chunks", "crc32_mod", "dropped", "large", "read", "run_bounds", "stored", "text_runs"]

#: A word is a run of anything but ASCII white space; bytes.split() on UTF-8 cuts in the same places.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
SPACES = " \t\n\x0b\x0c\r"


class Numbering(dict):
    """key → its number, in order of first sight; looking a key up numbers it."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc32_mod(col: str, n: int) -> Column:
    """crc32 of a column's text form, modulo n; null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def run_bounds(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of a text column with about `most` bytes together; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, most + ends[first] - sizes[first], side="right")))
        yield first, last
        first = last


def text_runs(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first, last, texts) of the runs of run_bounds; a run's texts alone become Python objects."""
    for first, last in run_bounds(column, most):
        yield first, last, column.slice(first, last - first).to_pylist()


def chunks(texts: list[str], most: int):
    """(first, last) bounds of runs of texts with about `most` characters together; a longer text is a run of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
