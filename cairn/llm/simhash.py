"""SimHash near-duplicates by anchor points: a covering code spreads anchors over the fingerprints' space.

The code is a product of perfect codes on parts of the fingerprint: two [23,12] Golay codes (covering radius 3) and, where
there are very many fingerprints, a [15,11] Hamming code (radius 1). Every fingerprint has one home anchor within the
covering radius of each part, and is replicated to all anchors within radius plus threshold, the threshold being shared
between the parts. If x and y differ in at most `threshold` bits, then y is replicated to x's home, so that comparing home
and replicated fingerprints per anchor finds every pair. Distinct fingerprints are compared, not documents: copies share
one, and a fingerprint has at most 64 + 2016 others within two bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import large, stored
from .graph import components



@dataclass(frozen=True)
class Code:
    """A perfect cyclic code on the `length` bits from `shift` on."""

    shift: int
    length: int
    generator: int
    radius: int

    @property
    def checks(self) -> int:
        return self.generator.bit_length() - 1


CODES = (Code(0, 23, 0b101011100011, 3), Code(23, 23, 0b101011100011, 3), Code(46, 15, 0b10011, 1))
#: Fingerprints to a home anchor, on average, beyond which the third code is used as well.
FULL = 16


def shingle_hashes(text: str | None, width: int = 3) -> list[int]:
    """XXH64 (seed 42) of each run of `width` words, lower-cased in A-Z only; of the whole sequence if there are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    return [hashed(join(x), 42) for x in zip(*(words[i:] for i in range(width)), strict=False)]


def fingerprint(text: str | None, width: int = 3) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for a text without words. Unsigned."""
    return majority(np.array(shingle_hashes(text, width), "<u8"))


def majority(h: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for part in np.array_split(h, max(1, len(h) // 4096)):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def syndromes(words: np.ndarray, code: Code) -> np.ndarray:
    """Remainders modulo the generator polynomial: words of one coset of the code share one."""
    r = words.astype(np.int64).copy()
    for bit in range(code.length - 1, code.checks - 1, -1):
        r ^= np.where(r >> bit & 1, code.generator << (bit - code.checks), 0)
    return r


@cache
def errors(code: Code, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of up to `most` bits, grouped by syndrome: (words, their excess over the radius, where each syndrome's run begins)."""
    words, layer = [0], [0]
    for _ in range(most):
        layer = [w | 1 << b for w in layer for b in range(w.bit_length(), code.length)]
        words += layer
    e = np.array(words)
    weight = np.array([w.bit_count() for w in words])
    s = syndromes(e, code)
    order = np.lexsort((e, weight, s))
    return e[order], np.maximum(0, weight[order] - code.radius), np.searchsorted(s[order], np.arange(2**code.checks + 1))


def anchors(fp: np.ndarray, blocks: int = 2, threshold: int = 2, home: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, anchor) for the home anchor of each fingerprint, or for all anchors within radius plus threshold."""
    index, anchor, left = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.full(len(fp), 0 if home else threshold)
    for code in CODES[:blocks]:
        e, excess, starts = errors(code, code.radius + threshold)
        word = (fp >> np.uint64(code.shift) & np.uint64(2**code.length - 1)).astype(np.int64)[index]
        s = syndromes(word, code)
        count = starts[s + 1] - starts[s]
        rows = np.repeat(np.arange(len(index)), count)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[s], count)
        fits = excess[at] <= left[rows]
        rows, at = rows[fits], at[fits]
        anchor = (anchor[rows] << (code.length - code.checks)) + ((word[rows] ^ e[at]) >> code.checks)
        index, left = index[rows], left[rows] - excess[at]
    return index, anchor


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp), fp as a signed long with the fingerprint's bits. A null text has no words, and so 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, threshold: int = 2, blocks: int | None = None) -> DataFrame:
    """distinct(fp), stored → (a, b): each pair of different fingerprints with at most `threshold` differing bits, once, a < b as signed longs.

    blocks: number of codes; by default the third is used where a home would have over `FULL` fingerprints. Links are the same.
    """
    if blocks is None:
        blocks = 2 if distinct.count() <= FULL * 2**24 else 3

    def spread(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fp = batch.column(0).to_numpy(zero_copy_only=False)
                for first in range(0, len(fp), 1000):
                    part = fp[first : first + 1000]
                    index, anchor = anchors(part.view(np.uint64), blocks, threshold, home)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[index])], ["anchor", "fp"])

        return distinct.mapInArrow(run, "anchor long, fp long")

    a, b = spread(True).toDF("anchor", "a"), spread(False).toDF("anchor", "b")
    return a.join(large(b), (a.anchor == b.anchor) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)).select("a", "b")


def near_duplicates(docs: DataFrame, threshold: int = 2, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint in hexadecimal, component_id, n_links.

    Documents link if their fingerprints differ in at most `threshold` bits. component_id is the smallest doc_id
    reachable; n_links counts the other distinct fingerprints that the document's own links to. Null and empty texts
    have fingerprint zero and link like others. A row without an id is reported with what it links to, and lends no id.
    Repeated rows are reported each; an empty table gives no rows. blocks: as in links.
    """
    fps = stored(fingerprints(docs, id_col, text_col))
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    pairs = stored(links(distinct.select("fp"), threshold, blocks))
    roots = components(pairs)
    member = distinct.join(large(roots.withColumnsRenamed({"node": "fp"})), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    known = stored(member.join(large(least), "root").join(large(degree), "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return fps.join(large(known), "fp").select("doc_id", F.lpad(F.translate(F.hex("fp"), "ABCDEF", "abcdef"), 16, "0").alias("fingerprint"), "component_id", "n_links")
