"""SentencePiece encoding and decoding with a shared-prefix Viterbi.

A text's spaces become marks, and marked words (marks, then what follows up to the next space or line end) are cut by
themselves: no piece reaches over a mark or a line end, so that this is the best cut of the whole text. A task gathers the
distinct marked words of a batch, sorts them, and walks them as a trie depth-first: forward scores of a prefix stand on a
stack and serve all words that share it. A file of merge ranks has no probabilities; a piece of rank r scores
-ln(r + 1) - ln(H), Zipf's law, H being the number's logarithm. Characters that no piece covers become their bytes.
"""

from __future__ import annotations

import gc
import math
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A literal mark in a text must not read as a space; no valid text holds a lone surrogate.
LITERAL = "\udc81"
UNITS = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")


class Pieces:
    """The vocabulary: pieces with scores, and ids of bytes."""

    def __init__(self, pieces: list[str], bytes_at: dict[int, int]) -> None:
        """pieces: by id, best first after the special ones, "" where an id stands for no text; bytes_at: id of each byte."""
        self.pieces, self.byte_ids = pieces, bytes_at
        self.byte_of = {i: b for b, i in bytes_at.items()}
        self.bytes_of = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        spread = math.log(math.log(len(pieces) + 1) + 1)
        texts = [(p, i) for i, p in enumerate(pieces) if p and i not in self.byte_of]
        self.scores = {p: (-math.log(rank + 1) - spread, i) for rank, (p, i) in enumerate(texts)}
        self.byte_score = -2 * math.log(len(pieces) + 1) - spread
        #: Every prefix of a piece, with (score, id) where it is a piece itself.
        self.prefixes: dict[str, tuple[float, int] | None] = {p[:n]: None for p in self.scores for n in range(1, len(p))} | self.scores

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        as_bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        return cls(["" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i) for i in range(n)], as_bytes)

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Each distinct marked word, in order, with its ids, by one depth-first walk over the sorted words."""
        prefixes, byte_score, byte_ids = self.prefixes, self.byte_score, self.byte_ids
        best, path, open_ = [0.0], [None], [()]  # of each prefix on the way down: score; (path before, id); where a piece that goes on may have begun
        find, before = prefixes.get, ""
        for word in sorted(words):
            if word.startswith(before):
                same = len(before)
            else:
                same = 0
                while before[same] == word[same]:
                    same += 1
                del best[same + 1 :], path[same + 1 :], open_[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                start = end - 1
                own = find(word[start:end], 0)
                if own:
                    top, at, id_, going = best[start] + own[0], start, own[1], [start]
                else:
                    raw = (MARK if word[start] == LITERAL else word[start]).encode()
                    top, at, id_, going = best[start] + byte_score * len(raw), start, None, [start] if own is None else []
                for begin in open_[start]:
                    piece = find(word[begin:end], 0)
                    if piece:
                        score = best[begin] + piece[0]
                        if score > top:
                            top, at, id_ = score, begin, piece[1]
                    elif piece == 0:
                        continue
                    going.append(begin)
                if id_ is None:
                    for b in raw:
                        own = (own, byte_ids[b]) if own else (path[start], byte_ids[b])
                    path.append(own)
                else:
                    path.append((path[at], id_))
                best.append(top)
                open_.append(going)
            out, step = [], path[-1]
            while step:
                out.append(step[1])
                step = step[0]
            out.reverse()
            yield word, out
            before = word

    def units(self, text: str) -> list[str]:
        """The marked words of a text, in order. The whole text is preceded by one mark; an empty text has none."""
        return UNITS.findall(MARK + text.replace(MARK, LITERAL).replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; where each text's ids end, led by 0)."""
        per_text = [self.units(t) for t in texts]
        number, flat = {}, []
        gc.disable()  # the walk makes millions of small tuples and no cycles
        try:
            for word, ids in self.encode_words(set(chain.from_iterable(per_text))):
                number[word] = len(flat)
                flat.append(ids)
        finally:
            gc.enable()
        size = np.fromiter(map(len, flat), np.int64, len(flat))
        begin, ids = np.cumsum(size) - size, np.fromiter(chain.from_iterable(flat), np.int32, int(size.sum()))
        codes = np.fromiter(map(number.__getitem__, chain.from_iterable(per_text)), np.int64)
        count = size[codes]
        at = np.cumsum(count)
        out = ids[np.arange(at[-1] if len(at) else 0) + np.repeat(begin[codes] - (at - count), count)]
        return out, np.append(0, at)[np.cumsum([0, *map(len, per_text)])]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids: pieces and bytes joined, marks back to spaces, without the mark at the front."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


@cache
def loaded(path: str) -> Pieces:
    return Pieces.load(path)


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, most: int = 4_000_000) -> DataFrame:
    """One row for each row of docs: doc_id, piece_ids, n_pieces. Null and empty texts have no pieces; repeated rows are encoded each.

    model: path of a SentencePiece file, the same on every executor; most: characters whose words share one trie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, last in chunks(texts, most):
                ids, ends = pieces.encode(texts[first:last])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists, pa.array(np.diff(ends), pa.int64())], ["doc_id", "piece_ids", "n_pieces"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, piece_ids array<int>, n_pieces long")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with the column text that piece_ids stand for: exactly the encoded text. Null ids have a null text; a column text that encoded has gives way."""
    encoded = encoded.drop("text")
    at = encoded.columns.index("piece_ids")
    schema = encoded.select("*", F.lit("").alias("text")).schema
    schema["text"].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            column = batch.column(at)
            texts = [None if not column[i].is_valid else pieces.decode(column[i].values.to_numpy(zero_copy_only=False).tolist()) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return encoded.mapInArrow(run, schema)
