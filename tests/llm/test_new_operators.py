"""Decontamination, hard negatives and conversation repair against brute force, and on odd rows."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from test_operators import lower, texts_of

from cairn.llm import conversation_repair, decontamination, hard_negatives, html_text

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- 11


def brute_items(text, items):
    w = ITEM_WORD.findall(lower(text or ""))
    hit, found = set(), set()
    for item, question in items:
        q = ITEM_WORD.findall(lower(question or ""))
        for g in [q[i : i + 10] for i in range(max(1, len(q) - 9))] if q else []:
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, "One, two THREE four five six seven eight nine ten eleven"), (10, "two three four five six seven eight nine ten eleven"), (2, "Naïve Straße"), (None, "x y"), (3, None), (4, "?!"), (5, ""), (2, "seven of nine"), (2, "seven of nine")]
TEXTS = [
    (1, "zero one two three; four five six seven-eight nine ten eleven twelve"), (2, "one two three four five six seven eight nine TEN"), (3, "a naïve, straße b x\x00y"), (4, "one two three four five six seven eight nine"),
    (5, None), (6, ""), (None, "seven of nine seven of nine"), (7, "x y x y x x y"), (7, "x y x y x x y"), (8, "word " * 50_000 + "seven of nine"),
]


@pytest.mark.parametrize("most", [200_000, 2])
def test_items_against_brute_force(spark, most):
    """With one automaton, and with windows dealt into many."""
    docs = spark.createDataFrame([(i, t, "w", 3) for i, t in TEXTS], "doc_id long, text string, window string, items int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontamination.find_items(docs, bench, most_windows=most).collect()
    got = sorted((repr(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in found)
    assert got == sorted((repr(i), *brute_items(t, ITEMS)) for i, t in TEXTS)
    texts = dict(TEXTS)
    for r in found:
        assert sum(b - a for a, b in r.words) == r.n_hit
        for (a, b), (start, end) in zip(r.words, r.spans, strict=True):
            assert ITEM_WORD.findall(lower(texts[r.doc_id][start:end])) == ITEM_WORD.findall(lower(texts[r.doc_id]))[a:b]


def test_items_on_documents(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.contamination(docs, bench).collect()}
    want = {}
    for i, t in texts_of(docs)[:40]:
        n, hit, names = brute_items(t, items)
        want[i] = (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0)
    assert {i: got[i] for i in want} == want


def test_items_on_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(None, None), (1, "no such words")], "item_id long, text string")
    assert decontamination.find_items(no_docs, bench).count() == 0
    for b in (bench, bench.limit(0)):
        found = decontamination.find_items(odd_docs, b)
        assert found.count() == odd_docs.count() and found.where("n_hit > 0 or size(items) > 0").count() == 0
    assert decontamination.without_passages("ab cd ef", [(0, 2), (6, 8)]) == "  cd  " and decontamination.without_passages(None, []) is None


# --- 12


def brute_negatives(rows, every=100):
    """rows: (id, label, ints)."""
    size = max((len(v) for _, _, v in rows), default=0)
    x = np.array([[*v, *[0] * (size - len(v))] for _, _, v in rows], np.int64).reshape(len(rows), size)
    out = []
    for n, (i, label, _) in enumerate(rows):
        if i % every == 0:
            s = x @ x[n]
            order = sorted((j for j in range(len(rows)) if j != n), key=lambda j: (-s[j], rows[j][0]))
            for p in [j for j in order if rows[j][1] == label][:5]:
                fits = [j for j in order if rows[j][1] != label and 30 * s[p] <= 100 * s[j] <= 90 * s[p]]
                out += [(i, rows[p][0], r + 1, rows[j][0], int(s[p]), int(s[j])) for r, j in enumerate(fits[:10])]
    return sorted(out)


def brute_prepared(rows):
    return [(i, (y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(np.float64(c) * 256)) for c in v]) for i, y, v in rows if y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]


PLAN = hard_negatives.MinePlan(block=7, part=60, tile=3)


@pytest.mark.parametrize("plan", [hard_negatives.MinePlan(), PLAN])
def test_negatives_against_brute_force(spark, sf, plan):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.label, r.embedding) for r in e.collect()]
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(e.repartition(3), plan=plan).collect()) == brute_negatives(brute_prepared(rows))


def test_negatives_with_ties_and_copies(spark):
    """A third of the rows are one vector; small whole components give ties; labels of one row; vectors of several lengths."""
    rng = random.Random(1)
    rows = [(i, 77 if i == 5 else rng.randrange(3), [0.5, 0.25, 0.0] if i % 3 == 0 else [rng.randrange(-3, 4) / 4 for _ in range(rng.choice((2, 3, 3, 4)))]) for i in range(0, 1500, 5)]
    rows += [(-100, 1, []), (-200, 1, [0.0, 0.0])]
    df = spark.createDataFrame([(i, y, v, 1, "s") for i, y, v in rows], "vec_id long, label int, embedding array<float>, slot int, block string")
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(df, plan=PLAN).collect()) == brute_negatives(brute_prepared(rows))


def test_negatives_on_odd_rows(spark):
    kind = "vec_id long, label int, embedding array<float>"
    odd = [(None, 1, [1.0, 0.0]), (1, None, [1.0, 0.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [float("nan"), 1.0]), (5, 1, [float("inf"), 1.0])]
    good = [(100, 1, [1.0, 0.5]), (101, 1, [1.0, 0.0]), (102, 2, [0.5, 0.5]), (103, 2, [1e30, -1e30])]
    want = brute_negatives([(i, y, [max(-(2**20), min(2**20, int(c * 256))) for c in v]) for i, y, v in good])
    assert want
    for rows in (good + odd, good + odd + good):  # equal rows count once
        assert sorted(tuple(r) for r in hard_negatives.hard_negatives(spark.createDataFrame(rows, kind)).collect()) == want
    for rows in ([], odd, good[1:], good[:2]):
        assert hard_negatives.hard_negatives(spark.createDataFrame(rows, kind)).count() == 0


def test_index_prunes():
    """Dimensions beyond an anchor's reach are left out, and all pairs at the threshold are found."""
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((400, 24)) * 50 * 0.8 ** np.arange(24))
    part, q = hard_negatives.Part(x), x[:6]
    least = 0.6 * (q**2).sum(axis=1)
    i, j, s = part.reached(q, least)
    want = {(a, b) for a, b in zip(*np.nonzero(q @ x.T >= least[:, None]), strict=True)}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and all(s == (q[i] * x[j]).sum(axis=1))


# --- 13


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub(r"[.!?]", "", text) if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def brute_repair(rows):
    """Left to right over all edits, keeping for each state the least (cost, audit, lines)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, counts, kinds = set(), dict.fromkeys("bdt ", 0), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not body else "d" if (role, text) in seen else " " if body[-1] in ".!?" else "t"
        seen.add((role, text))
        counts[fault] += 1
        kinds.append(fault)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    table = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(states):
        for _ in range(3):
            for (p, r), q in table.items():
                if p in states and r != "s":
                    c, a, lines = states[p]
                    states[q] = min(states.get(q, (10**9, "", [])), (c + 5, a + "I", [*lines, {"u": "user:", "a": "assistant:"}[r]]))
        return states

    states = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, kinds, strict=True):
        new = {p: (c + 2, a + "D", lines) for p, (c, a, lines) in states.items()}
        if fault not in "bd":
            more = 5 if fault == "t" else 0
            for (p, r), q in table.items():
                if p in states:
                    c, a, lines = states[p]
                    ways = [(c + more, a + "K", [*lines, f"{role}:{text}"])] if role[:1] == r else []
                    ways += [(c + more + 1, a + "R", [*lines, {"u": "user:", "a": "assistant:"}[r] + text])] if r != "s" else []
                    new[q] = min([new.get(q, (10**9, "", [])), *ways])
        states = inserted(new)
    cost, audit, lines = min(states[p] for p in ("", "a") if p in states)
    return gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute_conversations(rows):
    after = brute_damage(rows)
    return {conv: brute_repair([r[1:] for r in after if r[0] == conv]) for conv in {r[0] for r in rows}}


def conversations_of(df):
    return [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]


def test_repair_against_brute_force(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair_damaged(c.repartition(5)).collect()}
    assert got == brute_conversations(conversations_of(c))


TALK = "conv_id long, turn long, role string, text string, piece int, n string"


def random_talk(seed, convs, turns):
    rng = random.Random(seed)
    for c in range(convs):
        for _ in range(rng.randrange(1, turns)):
            text = rng.choice(["Yes.", "no", "Why?", "", " ", "So it is!", f"w{rng.randrange(9)}.", " ", "x. \n"])
            yield (c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice([text, None]), 1, "n")


def test_repair_of_odd_rows(spark):
    """Null ids, turns, roles and texts; ties; repeated rows; roles that the grammar hasn't; conversations that are dropped whole."""
    rows = [*random_talk(4, 60, 14), (None, 1, "user", "Hm.", 1, "n"), (None, None, "assistant", None, 1, "n"), *[(900, None, None, None, 1, "n")] * 300, *[(901, 3, "user", "Same.", 1, "n")] * 500]
    dropped = next(i for i in range(1000, 9999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone.", 1, "n"))
    df = spark.createDataFrame(rows, TALK)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair_damaged(df).collect()}
    assert got == brute_conversations([r[:4] for r in rows])
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversation_repair.repair_damaged(df.limit(0)).count() == 0


def test_long_conversation_in_fragments(spark):
    """One conversation of 2,000 turns over many partitions and blocks, beside short ones."""
    rng = random.Random(8)
    rows = [(0, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"t{t}.", f"t{t}", "Again!"]), 1, "n") for t in range(2000)] + list(random_talk(5, 10, 8))
    want = brute_conversations([r[:4] for r in rows])
    done = conversation_repair.repair(conversation_repair.damaged(spark.createDataFrame(rows, TALK).repartition(7)), block=16, fan=3)
    assert done.parts.where("conv_id = 0").count() > 100
    got = {r.conv_id: tuple(r)[1:] for r in done.summary.collect()}
    assert got == {c: w[:-1] for c, w in want.items() if c in got} and 0 in got
    assert {r.conv_id: r.repaired_sha256 for r in done.digests().collect()} == {c: want[c][-1] for c in got}
    lines = [f"{r.role}:{r.text}" for r in done.rows().where("conv_id = 0").orderBy("piece", "block", "number").collect()]
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[0][-1]


def test_cells_combine_in_any_split():
    rng = random.Random(3)
    for _ in range(200):
        kinds = [(rng.choice("suax"), rng.choice("bdt  ").strip()) for _ in range(rng.randrange(1, 9))]
        cells = [conversation_repair.row_cell(*k) for k in kinds]
        while len(cells) > 1:
            at = rng.randrange(len(cells) - 1)
            cells[at : at + 2] = [conversation_repair.product(*cells[at : at + 2])]
        assert conversation_repair.best(cells[0]) == conversation_repair.best(conversation_repair.span([(*k, 1) for k in kinds]))


def test_repair_scales_with_length():
    """A chart over all spans would take the cube of the length."""
    began = time.time()
    cost, audit = conversation_repair.best(conversation_repair.span([("ua"[k % 3 == 0], "t" if k % 7 == 0 else "", 1) for k in range(20_000)]))
    assert len(audit) >= 20_000 and cost > 0 and time.time() - began < 20


def test_damage(spark):
    rows = list(random_talk(6, 30, 10))
    got = conversation_repair.damaged(spark.createDataFrame(rows, TALK)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_damage([r[:4] for r in rows])))


# --- 2, time


@pytest.mark.parametrize("source", ["<a " * 200_000, "<a " * 100_000 + '">', "<a '" * 50_000 + ">", "<a b='\"' " * 50_000, "<table><td colspan=1000>" * 5000 + "x", "</script " * 100_000, "<script>" + "</script " * 100_000, "<!--" * 100_000, "<b" * 100_000, "<b" * 100_000 + ' ">'])
def test_odd_pages_take_linear_time(source):
    began = time.time()
    html_text.rendered(source)
    assert time.time() - began < 4


def test_tags_end_outside_quotes():
    assert html_text.rendered("<a title='x > y'>z</a> <b q=\">\">w") == "z w"
    assert html_text.rendered("1 <a 'b> 2 <i>c</i>") == "1 <a 'b> 2 c"
    assert html_text.rendered("<table><tr><td colspan=500>ab<td>c<tr><td colspan=500>d<td>e</table>") == "ab  c\nd   e"
