"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network in numpy, calibrated by a temperature.

A word is two tokens: its core (lower-cased, without punctuation at the ends) and its shape (case and the punctuation
around the core). A core's sparse random index vector follows from its hash, so that any number of words has one of its
own and no table holds them. A context vector is the sum, over the whole corpus, of the index vectors of the cores near
a core. Cores of the lexicon, the most frequent of the labelled texts, have a context vector each; all others have their
own index vector, and share context vectors by hash: `others` rows, whose meaning blurs as the vocabulary grows. Shapes
are few and are hashed to `shapes` rows. Tasks add up their own context vectors, and rows are summed in Spark. A document
is pooled over its cores, over its distinct cores, and over its shapes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_mod, run_bounds, stored

PUNCTUATION = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


@dataclass(frozen=True)
class Net:
    """lexicon: cores with a context vector of their own; most_labels: labelled documents that lexicon and network learn from, the first by a hash of their id; least: score from which a document is predicted good."""

    lexicon: int = 16_384
    others: int = 4096
    shapes: int = 256
    width: int = 64
    nonzero: int = 4
    near: int = 2
    hidden: int = 32
    most_labels: int = 20_000
    epochs: int = 25
    batch: int = 128
    rate: float = 0.003
    decay: float = 1e-4
    least: float = 0.7
    seed: int = 11

    @property
    def cores(self) -> int:
        return self.lexicon + self.others

    @property
    def rows(self) -> int:
        return self.cores + self.shapes


def buffers_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of strings that follow each other, where each begins and the last ends)"""
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2] or b"", np.uint8), bounds.astype(np.int64)


def tokens(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Of distinct words: their cores, and their shapes as numbers whose bytes, without those that are 0, are at most three of the punctuation before the core, its case, and at most three of what follows."""
    opened = pc.ascii_ltrim(words, characters=PUNCTUATION)
    core = pc.ascii_rtrim(opened, characters=PUNCTUATION)
    lower = pc.ascii_lower(core)
    (data, bounds), sizes = buffers_of(words), pc.binary_length(core).to_numpy(zero_copy_only=False).astype(np.int64)
    first, last = bounds[:-1], bounds[1:]
    at = last - pc.binary_length(opened).to_numpy(zero_copy_only=False)  # where the core begins
    letter = lambda i, ok: np.where(ok, data[np.minimum(i, len(data) - 1)], 0).astype(np.uint64)
    upper = pc.not_equal(core, lower).to_numpy(zero_copy_only=False)
    lowers = pc.not_equal(core, pc.ascii_upper(core)).to_numpy(zero_copy_only=False)
    head = letter(at, sizes > 0)
    case = np.select([lowers & ~upper, upper & ~lowers & (sizes > 1), (head >= 65) & (head <= 90), pc.ascii_is_decimal(core).to_numpy(zero_copy_only=False)], [ord(x) for x in "aATd"], ord("a")).astype(np.uint64)
    shape = case << np.uint64(24)
    for k in range(3):
        shape |= letter(first + k, first + k < at) << np.uint64(8 * k)
        shape |= letter(at + sizes + k, at + sizes + k < last) << np.uint64(8 * k + 32)
    return lower, shape


class Reader:
    """Words of texts; each distinct word of a run is looked at once. core, shape: rows by word; hash: of its core; kind: number of its core among the distinct ones by hash, so that equal texts add up in one order; kind_core, kind_hash: row and hash of these."""

    def __init__(self, net: Net, lexicon: np.ndarray) -> None:
        """lexicon: hashes of cores, sorted."""
        self.net, self.lexicon = net, lexicon
        self.shapes: dict[int, int] = {}

    def read(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word in the tables, number of words of each text, none if it is null); numbers hold until the next call."""
        net = self.net
        split = pc.ascii_split_whitespace(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = split.flatten()
        full = pc.greater(pc.binary_length(flat), 0)  # not what white space at a text's ends leaves
        if not pc.all(full, min_count=0).as_py():
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full.to_numpy(zero_copy_only=False)], minlength=len(sizes))
            flat = flat.filter(full)
        coded = flat.dictionary_encode()
        cores, shapes = tokens(coded.dictionary.cast(pa.string()))
        kinds = cores.dictionary_encode()
        data, bounds = buffers_of(kinds.dictionary)
        data = data.tobytes()
        hashes = np.fromiter((xxhash.xxh64_intdigest(data[i:j]) for i, j in pairwise(bounds.tolist())), np.uint64, len(bounds) - 1)
        order = np.argsort(hashes)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.kind, self.kind_hash = number[kinds.indices.to_numpy()], hashes[order]
        self.kind_core = (net.lexicon + self.kind_hash % np.uint64(net.others)).astype(np.int32)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, self.kind_hash), len(self.lexicon) - 1)
            self.kind_core = np.where(self.lexicon[at] == self.kind_hash, at, self.kind_core).astype(np.int32)
        self.core, self.hash = self.kind_core[self.kind], self.kind_hash[self.kind]
        found, which = np.unique(shapes, return_inverse=True)
        for x in set(found.tolist()) - self.shapes.keys():
            self.shapes[x] = net.cores + xxhash.xxh32_intdigest(x.to_bytes(8, "little").replace(b"\0", b"")) % net.shapes
        self.shape = np.fromiter(map(self.shapes.__getitem__, found.tolist()), np.int32, len(found))[which]
        return coded.indices.to_numpy(), sizes


def index_vectors(hashes: np.ndarray, net: Net) -> tuple[np.ndarray, np.ndarray]:
    """([n, nonzero] places, signs) of sparse random index vectors: one place in each of `nonzero` equal parts of the width, taken from the hash."""
    h = hashes.astype(np.uint64)[:, None] ^ np.uint64(net.seed * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    k, part = np.arange(net.nonzero, dtype=np.uint64), net.width // net.nonzero
    places = (h >> (np.uint64(8) * k + np.uint64(8)) & np.uint64(255)) % np.uint64(part) + k * np.uint64(part)
    return places.astype(np.int64), np.where(h >> (k + np.uint64(44)) & np.uint64(1), 1.0, -1.0)


def dense(hashes: np.ndarray, net: Net, dtype: type | np.dtype) -> np.ndarray:
    """[n, width] index vectors."""
    places, signs = index_vectors(hashes, net)
    out = np.zeros((len(hashes), net.width), dtype)
    out[np.arange(len(hashes))[:, None], places] = signs
    return out


def add_by_row(out: np.ndarray, row: np.ndarray, vectors: np.ndarray, levels: int = 16) -> None:
    """out[row[i]] += vectors[i] for each i; vectors of small integers. Rows met up to `levels` times add all their first vectors, all their second ones and so on, the others each theirs at once."""
    order = np.argsort(row, kind="stable")
    row = row[order]
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    count = np.diff(begin, append=len(row))
    few = np.flatnonzero(count <= levels)
    few = few[np.argsort(-count[few], kind="stable")]
    total = np.zeros((len(few), out.shape[1]), np.int32 if vectors.dtype.itemsize > 1 else np.int16)
    for k in range(count[few[0]] if len(few) else 0):
        n = np.searchsorted(-count[few], -k)  # those met more than k times
        total[:n] += vectors.take(order.take(begin[few[:n]] + k), axis=0)
    out[row[begin[few]]] += total
    one = np.ones(count.max(initial=0), np.float32)
    for i in np.flatnonzero(count > levels).tolist():
        out[row[begin[i]]] += one[: count[i]] @ vectors.take(order[begin[i] : begin[i] + count[i]], axis=0).astype(np.float32)


def context_table(words: np.ndarray, sizes: np.ndarray, reader: Reader, net: Net, out: np.ndarray, block: int = 65_536) -> None:
    """Adds to out, by row, the index vectors of the cores within `near` words of each core, of the shapes within `near` of each shape, and of a core for its own shape and the reverse."""
    table, near, n_kinds = out.reshape(net.rows, net.width), net.near, len(reader.kind_hash)
    small = np.min_scalar_type(-1 - 2 * near)  # holds the sum of 2 * near signs
    of_kinds, of_shapes = dense(reader.kind_hash, net, small), dense(np.arange(net.cores, net.rows), net, float)

    # a word's shape stands by its core: as often as the word
    kind, shape = reader.kind, reader.shape.astype(np.int64) - net.cores
    times = np.bincount(words, minlength=len(kind))
    for to, (places, signs), by in ((reader.core, index_vectors(np.arange(net.cores, net.rows), net), shape), (reader.shape, index_vectors(reader.kind_hash, net), kind)):
        for k in range(net.nonzero):
            np.add.at(out, to * np.int64(net.width) + places[by, k], signs[by, k] * times)

    # texts with `near` blanks before and after each, which have no vector, in blocks
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(words)) + near * (doc + 1)
    kinds = np.full(len(words) + near * (len(sizes) + 1), n_kinds)
    kinds[at] = kind[words]
    shapes = np.full(len(kinds), net.shapes)
    shapes[at] = shape[words]
    of_kinds = np.append(of_kinds, np.zeros((1, net.width), small), axis=0)
    rows = np.append(reader.kind_core, net.rows).astype(np.min_scalar_type(net.rows))
    for i in range(near, len(kinds) - near, block):
        j = min(i + block, len(kinds) - near)
        vectors = of_kinds.take(kinds[i - near : j + near], axis=0)
        around = np.zeros((j - i, net.width), small)
        for gap in range(1, near + 1):
            around += vectors[near - gap : near - gap + j - i]
            around += vectors[near + gap : near + gap + j - i]
        row = rows[kinds[i:j]]
        met = np.flatnonzero(row < net.rows)
        add_by_row(table, row[met], around if len(met) == len(row) else around.take(met, axis=0))
    side, pairs = net.shapes + 1, 0
    for gap in range(1, near + 1):
        pairs = pairs + np.bincount(shapes[gap:] * side + shapes[: len(shapes) - gap], minlength=side * side).reshape(side, side)
    if near:
        pairs = pairs[:-1, :-1]
        table[net.cores :] += (pairs + pairs.T) @ of_shapes


def unit(z: np.ndarray) -> np.ndarray:
    return (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(words: np.ndarray, sizes: np.ndarray, reader: Reader, contexts: np.ndarray, net: Net) -> np.ndarray:
    """[texts, 3 * width + 3]: means over cores, distinct cores and shapes of context and index vector, each of unit length; log length, and the shares of distinct cores and of words equal to the one before. contexts: unit context vectors by row."""
    n, d = len(sizes), net.width
    out = np.zeros((n, 3 * d + 3), np.float32)
    if not len(words):
        return out
    doc, full, kinds = np.repeat(np.arange(n), sizes), np.flatnonzero(sizes), len(reader.kind_hash)
    own = reader.kind[words]
    code, times = np.unique(doc * kinds + own, return_counts=True)
    of, which = code // kinds, code % kinds  # each distinct core of a text
    distinct = np.bincount(of, minlength=n)
    vectors = contexts[reader.kind_core] + dense(reader.kind_hash, net, np.float32) * np.float32(net.nonzero**-0.5)
    shares = np.stack([times / sizes[of], 1 / distinct[of]]).astype(np.float32)
    end = np.cumsum(distinct)
    for i, first, last in zip(full.tolist(), (end - distinct)[full].tolist(), end[full].tolist(), strict=True):
        out[i, : 2 * d] = (shares[:, first:last] @ vectors.take(which[first:last], axis=0)).ravel()
    shapes = np.bincount(doc * net.shapes + reader.shape[words] - net.cores, minlength=n * net.shapes).reshape(n, net.shapes)
    out[:, 2 * d : 3 * d] = (shapes / np.maximum(sizes, 1)[:, None]) @ contexts[net.cores :]
    again = np.bincount(doc[1:], (own[1:] == own[:-1]) & (doc[1:] == doc[:-1]), n)
    out[:, 3 * d] = np.log1p(sizes)
    out[:, 3 * d + 1] = distinct / np.maximum(sizes, 1)
    out[:, 3 * d + 2] = again / np.maximum(sizes, 1)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, net: Net) -> Network:
    """Trains on four fifths and finds the temperature on the rest. With one label only, every score is near that label's."""
    rng, n = np.random.default_rng(net.seed), len(x)
    order = rng.permutation(n)
    held, train = order[: n // 5], order[n // 5 :]
    mean, scale = (x[train].mean(axis=0), x[train].std(axis=0) + 1e-3) if len(train) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    rate0 = (y.sum() + 1) / (n + 2)
    out = Network(mean, scale, rng.standard_normal((x.shape[1], net.hidden)) * x.shape[1] ** -0.5, np.zeros(net.hidden), rng.standard_normal(net.hidden) * net.hidden**-0.5 * 0.1, float(np.log(rate0 / (1 - rate0))), 1.0)
    z = (x - mean) / scale
    names = ("w1", "b1", "w2", "b2")
    first, second, step = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), 0
    for _ in range(net.epochs):
        turn = rng.permutation(train)
        for i in range(0, len(turn), net.batch):
            at = turn[i : i + net.batch]
            h = np.maximum(z[at] @ out.w1 + out.b1, 0)
            dp = (1 / (1 + np.exp(-(h @ out.w2 + out.b2))) - y[at]) / len(at)
            dh = dp[:, None] * out.w2 * (h > 0)
            g = {"w1": z[at].T @ dh + net.decay * out.w1, "b1": dh.sum(axis=0), "w2": h.T @ dp + net.decay * out.w2, "b2": dp.sum()}
            step += 1
            for k in names:
                first[k], second[k] = 0.9 * first[k] + 0.1 * g[k], 0.99 * second[k] + 0.01 * g[k] ** 2
                setattr(out, k, getattr(out, k) - net.rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8))
    if len(held):
        logits = out.logits(x[held])
        loss = lambda t: float(np.mean(np.logaddexp(0, -np.where(y[held] > 0, 1, -1) * logits / t)))
        out.temperature = min((float(t) for t in np.geomspace(0.25, 8, 81)), key=loss)
    return out


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def texts_in(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, int, pa.Array]]:
    """(first, last, texts) of runs of a batch's second column."""
    for i, j in run_bounds(batch.column(1), most):
        yield i, j, batch.column(1).slice(i, j - i)


def lexicon_of(sample: DataFrame, net: Net) -> np.ndarray:
    """Hashes, sorted, of the cores that stand in the most texts of the sample, in two at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net, np.zeros(0, np.uint64))
        for batch in batches:
            for _, j, texts in texts_in(batch, 1_000_000):
                words, sizes = reader.read(texts)
                if len(words):
                    kinds = len(reader.kind_hash)
                    n = np.bincount(np.unique(np.repeat(np.arange(len(sizes)), sizes) * kinds + reader.kind[words]) % kinds, minlength=kinds)
                    yield pa.RecordBatch.from_arrays([pa.array(reader.kind_hash.view(np.int64)), pa.array(n)], ["core", "n"])

    counts = sample.mapInArrow(run, "core long, n long").groupBy("core").agg(F.sum("n").alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "core").limit(net.lexicon).select("core").toPandas()  # net.lexicon rows
    return np.sort(top["core"].to_numpy(np.int64).view(np.uint64))


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of `width` numbers each, as rows."""
    return lists.combine_chunks().flatten().to_numpy().reshape(-1, width)


def features(rows: DataFrame, shared, net: Net) -> DataFrame:
    """(doc_id, x): the pooled vector of each text. shared: broadcast lexicon and unit context vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, contexts = shared.value
        reader = Reader(net, lexicon)
        for batch in batches:
            for i, j, texts in texts_in(batch, 1_000_000):
                x = pooled(*reader.read(texts), reader, contexts, net)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], ["doc_id", "x"])

    return rows.mapInArrow(run, "doc_id long, x array<float>")


def classify_quality(docs: DataFrame, labels: DataFrame, net: Net = Net(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Labels count only from ids whose crc32 modulo 4 is not 2; null labels don't count, and of several for an id the
    largest does. Of labelled rows with one id the one whose text has the least hash teaches. Context vectors are summed
    over all rows. Null and empty texts pool to zeros and are scored like others; repeated rows are scored each.
    """
    spark, rows = docs.sparkSession, text_rows(docs, id_col, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null").where(crc32_mod("doc_id", 4) != 2)
    known = stored(known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(net.seed)), "doc_id").limit(net.most_labels))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    sample = stored(rows.join(F.broadcast(known), "doc_id").withColumn("nth", nth).where("nth = 1").drop("nth"))  # known: most_labels rows of two numbers
    lexicon = lexicon_of(sample.select("doc_id", "text"), net)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = Reader(net, lexicon), np.zeros(net.rows * net.width)
        for batch in batches:
            for _, _, texts in texts_in(batch, 2_000_000):
                context_table(*reader.read(texts), reader, net, total)
        total = total.reshape(net.rows, net.width).astype(np.float32)
        met = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1) * net.width, pa.int32()), pa.array(total[met].ravel()))], ["row", "v"])

    sums = rows.mapInArrow(tables, "row long, v array<float>").groupBy("row").agg(F.array(*(F.sum(F.col("v")[i]).cast("float") for i in range(net.width))).alias("v")).toArrow()  # net.rows at most
    table = np.zeros((net.rows, net.width), np.float32)
    table[sums["row"].to_numpy()] = matrix(sums["v"], net.width)
    vectors = spark.sparkContext.broadcast((lexicon, unit(table)))

    got = features(sample.select("doc_id", "text"), vectors, net).join(known, "doc_id").toArrow().sort_by("doc_id")  # most_labels rows, each id once
    shared = spark.sparkContext.broadcast(fit(matrix(got["x"], 3 * net.width + 3).astype(float), got["label"].to_numpy().astype(float), net))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, contexts = vectors.value
        reader = Reader(net, lexicon)
        for batch in batches:
            for i, j, texts in texts_in(batch, 1_000_000):
                scores = shared.value.score(pooled(*reader.read(texts), reader, contexts, net))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in (batch.column(0), batch.column(2))), pa.array(scores), pa.array((scores >= net.least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.withColumn("held_out", crc32_mod("doc_id", 4) == 2).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
