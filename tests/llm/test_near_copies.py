"""The pipeline's near-duplicates stage against brute-force Jaccard similarity of five-word runs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from test_operators import texts_of

from cairn.llm import mixing, near_copies
from cairn.llm.common import stored


def runs(t):
    w = t.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute_pairs(rows):
    sets = [(i, runs(t)) for i, t in rows]
    return {(i, j) for n, (j, b) in enumerate(sets) for i, a in sets[:n] if len(a & b) >= 0.8 * len(a | b)}


def brute_stays(rows):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in brute_pairs(rows):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return sorted(i for i in root if find(i) == i)


@pytest.fixture(scope="module")
def edited(spark):
    """150 texts and for each three with some words replaced, from hardly any to too many."""
    rng, rows = random.Random(3), []
    for g in range(150):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 300))]
        rows.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randrange(1, 2 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_recall_of_candidates(spark, edited):
    """Of the pairs at 0.8 or more, 99.9 % share a band; all links are at 0.8 or more."""
    rows = texts_of(edited)
    want = brute_pairs(rows)
    least = {i: near_copies.least_hashes(np.unique(np.array(near_copies.shingle_hashes(t, 5), np.uint64))) for i, t in rows}
    keys = {i: set(near_copies.bands(x).tolist()) for i, x in least.items()}
    assert len(want) > 200
    assert sum(bool(keys[a] & keys[b]) for a, b in want) >= 0.999 * len(want)
    assert all((least[a].astype(np.uint8) == least[b].astype(np.uint8)).mean() >= 0.68 for a, b in want)


def test_stage_against_brute_force(spark, edited):
    assert sorted(i for i, _ in texts_of(corpus_pipeline.dedup(spark, edited, ""))) == brute_stays(texts_of(edited))


def test_stage_on_documents(spark, docs, sf):
    assert sorted(i for i, _ in texts_of(corpus_pipeline.dedup(spark, docs, sf))) == brute_stays(texts_of(docs))


def test_odd_rows(spark, odd_docs, no_docs):
    kept = near_copies.one_of_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    # 3 has one more run of five than the ten of 1; 4, 5 and 6 have no words
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect() if r.doc_id) == [(False, i) for i in (1, 4, 7, 8, 9, 10, 11)]
    assert kept.where("doc_id is null").count() == 2
    assert stored(near_copies.one_of_near_copies(no_docs)).count() == 0


def test_ties(spark):
    """Rows that share an id, in any order: each text's group keeps one, and of equal rows one stays."""
    a, b = "a b c d e f g h", "q r s t u v w x"
    rows = [(1, a, "s"), (7, a, "s"), (7, b, "s"), (7, b, "t"), (7, b, "s"), (9, None, "s"), (8, "", "s")]
    for order in (rows, rows[::-1]):
        for n in (1, 3):
            kept = near_copies.one_of_near_copies(spark.createDataFrame(order, "doc_id long, text string, source string").repartition(n))
            got = sorted((r.doc_id, r.text) for r in kept.collect())
            assert got == [(1, a), (7, b), (8, "")]
    picked = {near_copies.one_of_near_copies(spark.createDataFrame(o, "doc_id long, text string, source string")).where("doc_id = 7").first().source for o in (rows, rows[::-1])}
    assert len(picked) == 1


CLASHES = ["_n", "_id", "_key", "_k", "row", "key", "n", "id", "copy", "nth", "text_id", "root", "ratio", "doc_ID2"]


def test_clashing_columns(spark):
    """Columns with any name come through both stages as they were."""
    rows = [(i, f"t{i % 7} " * 3 + " ".join(f"w{i % 7 * 50 + j}" for j in range(40)), "ab"[i % 2], *[100 * i + c for c in range(len(CLASHES))]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in CLASHES))
    by_id = {r[0]: tuple(r) for r in df.collect()}
    kept = near_copies.one_of_near_copies(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [by_id[i] for i in range(7)]
    mixed = mixing.mixed_documents(df)
    got = [tuple(r) for r in mixed.collect()]
    assert mixed.columns == df.columns and got and all(r == by_id[r[0]] for r in got)


def test_all_pairs_without_a_sketch(spark, edited):
    sifted, every = (sorted(r.doc_id for r in near_copies.one_of_near_copies(edited, slack=s).select("doc_id").collect()) for s in (0.12, None))
    assert sifted == every == brute_stays(texts_of(edited))


def test_members_meet_their_head_in_groups(spark):
    base = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join(base[:i] + ["x"] + base[i:]) if i else " ".join(base)) for i in range(60)] + [(100, "other words in a text")]
    whole = spark.createDataFrame(rows, "key long, text string")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(0, 100)], "a long, b long")
    got = {(r.a, r.b) for r in near_copies.confirmed(pairs, whole, 5, 0.8, per_task=7).collect()}
    assert got == {(a, b) for a, b in brute_pairs(rows) if a == 0} | {(0, b) for b, a in brute_pairs(rows) if a == 0} and len(got) == 59


def test_few_pairs_of_a_group_that_does_not_link(spark):
    """Variants of one text whose changes recur, so that no run is one text's alone: all links are among the pairs, which are few."""
    rng, base, rows = random.Random(8), [f"w{k}" for k in range(150)], []
    for i in range(200):
        copy = list(base)
        for at in rng.sample(range(0, 150, 5), 4 if i % 9 else 3):
            copy[at] = f"v{at}_{rng.randrange(6)}"
        rows.append((i, " ".join(copy)))
    whole = spark.createDataFrame(rows, "key long, text string")
    left = spark.createDataFrame([(i, len(runs(t)), i) for i, t in rows], "key long, n long, root long")
    pairs = [(min(r.a, r.b), max(r.a, r.b)) for r in near_copies.possible(near_copies.rare_runs(left, whole, 5, 0.8), 0.8).collect()]
    want = brute_pairs(rows)
    assert want and want <= set(pairs)
    assert len(pairs) < 200 * 199 / 2 / 2  # by the runs that a text has alone, all arise
