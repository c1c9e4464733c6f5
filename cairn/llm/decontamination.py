"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items, run once over each text.

Texts are normalised to words; the automaton's letters are words, so that a window of ten words is ten steps deep however
long they are. Hits are intervals of words, and are mapped back to code points of the original text. The windows of a test
set are counted before anything is sent out: an automaton holds `most_windows` at most, and where there are more, they are
dealt into several, which the texts pass one after the other, each pass written to the shared folder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbering, stored, text_runs

#: To UTF-8: A-Z in lower case, every other ASCII character but letters and digits a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: The same words in an original text.
ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HITS = "array<struct<first: long, last: long>>"
RESULT = f"doc_id long, n_words long, n_hit long, items array<string>, words {HITS}, spans array<struct<start: long, end: long>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def window_texts(text: bytes | None, width: int) -> Iterator[bytes]:
    """Each `width` consecutive words; of a text of fewer, but not none, all."""
    words = words_of(text)
    for i in range(max(min(1, len(words)), len(words) - width + 1)):
        yield b" ".join(words[i : i + width])


def item_windows(benchmark: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """(window, item), each pair once. An item without an id has the empty id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_pylist()
            for first, _, texts in text_runs(batch.column(1), 1_000_000):
                found = [(w.decode(), items[first + i]) for i, t in enumerate(texts) for w in window_texts(t, width)]
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([i for _, i in part], pa.string())], ["window", "item"])

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "window string, item string").distinct()


class Matcher:
    """The automaton of (window, item) pairs; a window stands in it once, with its length and items."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.numbers = Numbering({b"": 0})  # 0: a word of no window
        by_window: dict[str, list[str]] = {}
        for window, item in pairs:
            by_window.setdefault(window, []).append(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in by_window.items():
            key = tuple(self.numbers[w] for w in window.encode().split())
            self.automaton.add_word(key, (len(key), items))
        self.automaton.make_automaton()
        self.empty = not by_window

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(intervals [first, last) of words inside any window, items found)."""
        found, items = [], set()
        if words and not self.empty:
            for end, (length, names) in self.automaton.iter(tuple(map(self.numbers.get, words, repeat(0)))):
                found.append((end + 1 - length, end + 1))
                items.update(names)
        return merged(found), items


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals, those that touch as one, in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(intervals):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def original_spans(text: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points [start, end) of the text that intervals of words cover."""
    out, at = [], 0
    for k, m in enumerate(ORIGINAL.finditer(text.decode("utf-8", "surrogatepass"))):
        while at < len(hits) and hits[at][1] <= k:
            at += 1
        if at == len(hits):
            break
        first, last = hits[at]
        if k == first:
            start = m.start()
        if k == last - 1:
            out.append((start, m.end()))
    return out


def find_items(docs: DataFrame, benchmark: DataFrame, width: int = 10, most_windows: int = 200_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, items, words, spans.

    A window is `width` consecutive words of an item, or all words of a shorter one. n_hit counts the words inside any
    window; words are their intervals, spans the same in code points of the original text, both with the end exclusive;
    items are the items with occurring windows, sorted as strings. A null or empty text has no words. Rows with a null or
    repeated id are rows like others; items of one id are one item, those without an id one of the empty id. Without
    items, or with items that have no words, nothing is hit. Other columns are ignored; no rows give none.
    """
    spark = docs.sparkSession
    pairs = stored(item_windows(benchmark, width, item_col, item_text_col))
    n_parts = max(1, -(-pairs.count() // most_windows))
    dealt = F.pmod(F.xxhash64("window", "item"), F.lit(n_parts))

    def scan(part: int, last: bool):
        own = spark.sparkContext.broadcast([tuple(r) for r in pairs.where(dealt == part).collect()])  # about most_windows rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(own.value)
            for batch in batches:
                for first, end, texts in text_runs(batch.column(1), 4_000_000):
                    before, named = (batch.column(k).slice(first, end - first).to_pylist() for k in (2, 3))
                    rows = []
                    for text, hits, items in zip(texts, before, named, strict=True):
                        words = words_of(text)
                        fresh, more = matcher.hits(words)
                        hits = merged([*fresh, *((h["first"], h["last"]) for h in hits)]) if hits else fresh
                        rows.append((len(words), hits, sorted(more.union(items)), original_spans(text, hits) if last and hits else []))
                    yield batch_of(batch, first, end, rows, last)

        return run

    def batch_of(batch: pa.RecordBatch, first: int, end: int, rows: list[tuple], last: bool) -> pa.RecordBatch:
        pair = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
        structs = lambda k, a, b: pa.array([[{a: x, b: y} for x, y in r[k]] for r in rows], pair(a, b))
        ids, hits, items = batch.column(0).slice(first, end - first), structs(1, "first", "last"), pa.array([r[2] for r in rows], pa.list_(pa.string()))
        if not last:
            return pa.RecordBatch.from_arrays([ids, batch.column(1).slice(first, end - first), hits, items], ["doc_id", "text", "words", "items"])
        counts = [pa.array([r[0] for r in rows], pa.int64()), pa.array([sum(y - x for x, y in r[1]) for r in rows], pa.int64())]
        return pa.RecordBatch.from_arrays([ids, *counts, items, hits, structs(3, "start", "end")], ["doc_id", "n_words", "n_hit", "items", "words", "spans"])

    none = [F.array().cast(HITS).alias("words"), F.array().cast("array<string>").alias("items")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), *none)
    for part in range(n_parts - 1):
        rows = stored(rows.mapInArrow(scan(part, False), f"doc_id long, text binary, words {HITS}, items array<string>"))
    return rows.mapInArrow(scan(n_parts - 1, True), RESULT)


def without_passages(text: str | None, spans: list[tuple[int, int]], mark: str = " ") -> str | None:
    """The text with `mark` in place of each span, as a task would cut what find_items reports."""
    if not text:
        return text
    out, at = [], 0
    for start, end in spans:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """find_items with a digest of the items: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = find_items(docs, benchmark, **options)
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"), "spans")

