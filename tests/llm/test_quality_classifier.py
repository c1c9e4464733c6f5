"""The quality classifier's reader, context vectors and pooling, each against a form that looks at one word or pair at a time."""

import random
import string
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cairn.llm import quality_classifier


def words_by_hand(text):
    """(hash of the core, shape) of each word."""
    for word in text.encode().split():
        core = word.strip(string.punctuation.encode())
        at = word.find(core) if core else len(word)
        case = "a" if core.islower() else "A" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "d" if core.isdigit() else "a"
        yield xxhash.xxh64_intdigest(core.lower()), word[: min(at, 3)] + case.encode() + word[at + len(core) :][:3]


def test_words_of_texts():
    """Cores and shapes of odd words are those found word by word."""
    q, rng = quality_classifier, random.Random(3)
    net = q.Net(lexicon=50, others=64)
    texts = ["".join(rng.choices("aBz09.,-(\"'é😀\x00\x1c\x85  \n\t", k=rng.randrange(60))) for _ in range(400)] + ["", " \n", None, "A", "...", "....a....", "É", "x"]
    lexicon = np.unique(np.array([h for t in texts for h, _ in words_by_hand(t or "")], np.uint64))[::3][:50]
    reader = q.Reader(net, lexicon)
    for given in (texts, pa.array(["cut off", *texts])[1:], [None, ""], []):
        words, sizes = reader.read(given)
        want = [list(words_by_hand(t or "")) for t in (given.to_pylist() if isinstance(given, pa.Array) else given)]
        flat = [w for t in want for w in t]
        assert sizes.tolist() == [len(t) for t in want]
        assert reader.hash[words].tolist() == [h for h, _ in flat]
        assert reader.shape[words].tolist() == [net.cores + xxhash.xxh32_intdigest(s) % net.shapes for _, s in flat]
        assert reader.core[words].tolist() == [int(np.searchsorted(lexicon, h)) if h in lexicon else net.lexicon + h % net.others for h, _ in flat]


@pytest.mark.parametrize("near", [0, 2, 70])
def test_context_table_in_blocks(near):
    """Words far more frequent than others, texts longer and shorter than a block: the table is the sum pair by pair."""
    q, rng = quality_classifier, np.random.default_rng(5)
    net = q.Net(lexicon=4, others=8, shapes=4, width=8, nonzero=2, near=near)
    texts = [" ".join(f"W{w}" if w % 3 else f"w{w}," for w in rng.zipf(1.5, n) % 40) for n in (0, 1, 200, 3, 90)]
    reader = q.Reader(net, np.sort(np.array([xxhash.xxh64_intdigest(w) for w in (b"w1", b"w2", b"w3")], np.uint64)))
    words, sizes = reader.read(texts)
    vectors, want, at = np.zeros((len(reader.hash) + net.rows, net.width)), np.zeros((net.rows, net.width)), 0
    np.put_along_axis(vectors, *q.index_vectors(np.append(reader.hash, np.arange(net.rows, dtype=np.uint64)), net), axis=1)
    own, shapes = vectors[: len(reader.hash)], vectors[len(reader.hash) :]
    for n in sizes:
        r = words[at : at + n]
        for i in range(n):
            want[reader.core[r[i]]] += shapes[reader.shape[r[i]]]
            want[reader.shape[r[i]]] += own[r[i]]
            for j in range(max(0, i - near), min(n, i + near + 1)):
                if i != j:
                    want[reader.core[r[i]]] += own[r[j]]
                    want[reader.shape[r[i]]] += shapes[reader.shape[r[j]]]
        at += n
    for block in (37, 65_536):
        got = np.zeros(net.rows * net.width)
        q.context_table(words, sizes, reader, net, got, block)
        assert (got.reshape(want.shape) == want).all()


def test_equal_texts_pool_alike():
    """Whatever stands in the same run."""
    q, rng = quality_classifier, np.random.default_rng(8)
    net = q.Net()
    contexts = q.unit(rng.standard_normal((net.rows, net.width)))
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.3, n) % 500) for n in (700, 30, 3000)]
    reader = q.Reader(net, np.zeros(0, np.uint64))
    alone = [q.pooled(*reader.read([t]), reader, contexts, net)[0] for t in texts]
    together = q.pooled(*reader.read(["w9 w3 w400", *texts[::-1]]), reader, contexts, net)[:0:-1]
    assert all((a[:128] == b[:128]).all() for a, b in zip(alone, together, strict=True))


def test_classifier_work():
    """Both passes over the texts together cost under 5 times what it takes to cut, lower-case and count the words one by one."""
    q, rng = quality_classifier, np.random.default_rng(2)
    net = q.Net()
    texts = [" ".join(f"w{w}," for w in np.where(rng.random(400) < 0.2, rng.integers(10**6, size=400), rng.zipf(1.2, 400) % 20_000)) for _ in range(1000)]
    contexts, table = np.ones((net.rows, net.width), np.float32), np.zeros(net.rows * net.width)

    def plain():
        Counter(w.strip(".,").lower() for t in texts for w in t.split())

    def passes():
        reader = q.Reader(net, np.zeros(0, np.uint64))
        q.context_table(*reader.read(texts), reader, net, table)
        reader = q.Reader(net, np.zeros(0, np.uint64))
        q.pooled(*reader.read(texts), reader, contexts, net)

    def cost(f):
        start = time.thread_time()
        f()
        return time.thread_time() - start

    least, most = np.min([(cost(plain), cost(passes)) for _ in range(5)], axis=0)
    assert most < 5 * least, most / least
