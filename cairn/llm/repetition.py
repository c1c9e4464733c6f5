"""Quality rules from a suffix array: repeated substrings of a text are the intervals of its longest-common-prefix array.

The array is built over words by prefix doubling, for many texts at once and each text by itself. Suffixes that no longer
share a prefix with another leave the doubling, so that clean texts cost two or three short sorts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD_RE, chunks

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, covered_chars double, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the verdict. Lengths are in words; fractions are of the words' code points."""

    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    max_covered_chars: float = 0.25
    max_longest: int = 100


def repeats(words: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """For each place the length of the longest substring that starts there and occurs elsewhere in the same text, 0 if under `window`.

    words: codes; doc: the text of each place, ascending. The length is the larger of the two neighbouring values in
    the longest-common-prefix array, and the union of [place, place + length) over all places is the union of all
    maximal repeats of `window` words or more.
    """
    n = len(words)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    end = np.searchsorted(doc, doc, side="right")  # where a place's text ends
    order = np.lexsort((words, doc))
    new = np.ones(n, bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (words[order][1:] != words[order][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    suffixes = order.copy()
    alone = new & np.append(new[1:], True)
    active = np.flatnonzero(~alone)  # places in the array that still share their class
    levels, length = [(1, rank.copy())], 1
    while len(active):
        at = suffixes[active]
        ahead = at + length
        second = np.where(ahead < end[at], rank[np.minimum(ahead, n - 1)], -1)
        o = np.lexsort((second, rank[at]))
        at, major, minor = at[o], rank[at][o], second[o]
        new = np.ones(len(at), bool)
        new[1:] = (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])
        suffixes[active] = at  # classes keep their places, so that sorting within them sorts the array
        head = np.maximum.accumulate(np.where(new, active, 0))
        rank = rank.copy()
        rank[at] = head
        alone = new & np.append(new[1:], True)
        active = active[~alone]
        length *= 2
        levels.append((length, rank))
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    pair = np.flatnonzero(levels[0][1][a] == levels[0][1][b])
    a, b = a[pair], b[pair]
    lcp = np.zeros(len(pair), np.int64)
    for length, level in reversed(levels):
        inside = (a < n) & (b < n)
        i, j = np.minimum(a, n - 1), np.minimum(b, n - 1)
        same = inside & (level[i] == level[j]) & (a + length <= end[i]) & (b + length <= end[j]) & (doc[i] == doc[j])
        a, b, lcp = a + length * same, b + length * same, lcp + length * same
    lcp[lcp < window] = 0
    np.maximum.at(out, suffixes[:-1][pair], lcp)
    np.maximum.at(out, suffixes[1:][pair], lcp)
    return out


def measure(texts: list[str], rules: RepetitionRules) -> list[tuple]:
    """The counts and verdict of each text."""
    codes: dict[bytes, int] = {}
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    words = np.fromiter((codes.setdefault(w, len(codes)) for ws in split for w in ws), np.int64, int(sizes.sum()))
    chars = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in codes), np.int64, len(codes))[words] if codes else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    lengths = repeats(words, doc, rules.window)
    starts = np.flatnonzero(lengths)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths[starts], -1)
    covered = np.cumsum(edge[:-1]) > 0
    n_repeat = np.bincount(doc[covered], minlength=len(texts))
    covered_chars = np.bincount(doc[covered], chars[covered], minlength=len(texts))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc[starts], lengths[starts])
    out = []
    for i, text in enumerate(texts):
        n = int(sizes[i])
        word_chars = len(text) - sum(map(text.count, SPACES))
        seen: set[str] = set()
        dup = 0
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif WORD_RE.search(line):
                seen.add(line)
        part = covered_chars[i] / word_chars if word_chars else 0.0
        failed = n < rules.min_words or 100 * int(n_repeat[i]) > rules.max_repeat_percent * n
        kept = not failed and part <= rules.max_covered_chars and int(longest[i]) <= rules.max_longest
        out.append((n, word_chars, sum(map(text.count, "#*$%&|<>")), dup, int(n_repeat[i]), int(longest[i]), float(part), failed, kept))
    return out


def measured(texts: list[str], rules: RepetitionRules, most: int = 3_000_000) -> Iterator[tuple]:
    for first, last in chunks(texts, most):
        yield from measure(texts[first:last], rules)


def quality_rules(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs with its counts and verdict.

    A null text has no words, and so fails. Rows with a null or repeated id are judged like others; other columns are
    ignored, and an empty table gives no rows.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(measured([t or "" for t in batch.column(1).to_pylist()], rules))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [*[pa.int64()] * 6, pa.float64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(judge, SCHEMA)


def kept_documents(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that the rules keep. Null and empty texts go; repeated rows are judged each; an empty table gives no rows."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [row[-1] for row in measured([t or "" for t in batch.column(at).to_pylist()], rules)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
