"""Conversation structure repair by weighted interval parsing.

A grammar in Chomsky normal form: a nonterminal [p, q] for each two states of what a conversation may be, (s?(ua)+)?, with
[p, q] → [p, r] [r, q] over two neighbouring spans, and [p, q] → a row that is kept, given another role or deleted. A span's
cell holds for each nonterminal the least (cost, audit); insertions take no row, so that cells are closed under them on both
sides. Cells are combined bottom-up by span length, 1, 2, 4, …: as the grammar is regular, every split of a span has the
same derivations, and one split of each will do. Of two audits of one cell and cost neither begins with the other (letters
that take the same rows cost the same, and more insertions cost more), so the least audit of a whole is made of least parts.

Rows are dealt out by ranges of (conversation, turn, role, text), so a long conversation lies over many partitions and its
fragments' cells meet afterwards, a bounded number at a time. Equal rows travel as one with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import stored

#: States: at the start; a system row was last; a user row; an assistant row.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
ENDS = (START, ASSISTANT)
STEPS = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NAMES = {"u": "user", "a": "assistant"}
SPACE = r"[\x20\x09-\x0D]"

#: [p, q] → (cost, audit)
Cell = dict[tuple[int, int], tuple[int, str]]


def least(cells: Iterator[tuple[tuple[int, int], tuple[int, str]]]) -> Cell:
    out: Cell = {}
    for key, value in cells:
        if key not in out or value < out[key]:
            out[key] = value
    return out


def product(a: Cell, b: Cell) -> Cell:
    """[p, q] → [p, r] [r, q]."""
    return least(((p, q), (x + y, s + t)) for (p, r), (x, s) in a.items() for (v, q), (y, t) in b.items() if v == r)


def closure() -> Cell:
    """The cell of an empty span: nothing, or insertions."""
    nothing: Cell = {(p, p): (0, "") for p in STATES}
    one = least(((p, q), (INSERT, "I")) for role in "ua" for p, q in STEPS[role])
    out = nothing
    for _ in STATES:
        out = least(x for c in (out, product(out, one)) for x in c.items())
    return out


@cache
def row_cell(initial: str, fault: str) -> Cell:
    """A row's cell, closed under insertions. fault: b(lank), d(uplicate), t(runcated) or none."""
    more = TRUNCATED if fault == "t" else 0
    edits = [((p, p), (DELETE, "D")) for p in STATES]
    if fault not in ("b", "d"):
        edits += [(step, (more, "K")) for step in STEPS.get(initial, ())]
        edits += [(step, (REROLE + more, "R")) for role in "ua" for step in STEPS[role]]
    return product(product(closure(), least(iter(edits))), closure())


@cache
def short_span(rows: tuple[tuple[str, str], ...]) -> Cell:
    """The cell of up to eight rows; conversations are full of the same ones."""
    if len(rows) == 1:
        return row_cell(*rows[0])
    half = len(rows) // 2
    return product(short_span(rows[:half]), short_span(rows[half:]))


def combined(cells: list[Cell]) -> Cell:
    """Neighbouring spans, pair by pair, until one is left."""
    while len(cells) > 1:
        cells = [product(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else closure()


def power(cell: Cell, n: int) -> Cell:
    """The cell of n neighbouring spans that are alike."""
    half = power(cell, n // 2) if n > 1 else None
    return cell if half is None else product(half, half) if n % 2 == 0 else product(product(half, half), cell)


def span(rows: list[tuple[str, str, int]]) -> Cell:
    """The cell of rows of (initial, fault, n): one, and n - 1 duplicates of it."""
    cells, run = [], []
    for initial, fault, n in rows:
        run.append((initial, fault))
        if len(run) == 8 or n > 1:
            cells.append(short_span(tuple(run)))
            run = []
        if n > 1:
            cells.append(power(row_cell(initial, "d"), n - 1))
    return combined([*cells, short_span(tuple(run))] if run else cells)


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[START, q] for q in ENDS if (START, q) in cell)


def edited(rows: Iterator[tuple[str, str]], audit: str, state: str) -> Iterator[tuple[str, str, str]]:
    """Rows of (role, text) under an audit → (edit, role, text) of what stands afterwards; state: the initial of the row before, or none."""
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = NAMES["a" if state == "u" else "u"]
        state = role[:1]
        yield edit, role, text


# --- rows


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with the test damage that a hash of conversation and turn deals: dropped, emptied, cut short, repeated, made a user's; null roles and texts are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")), F.lit(20))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def placed(rows: DataFrame, block: int) -> DataFrame:
    """rows(conv_id, turn, role, text) → stored (conv_id, piece, block, seq, turn, role, text, fault, n), by turn, role and text, null turns first; n equal rows are one, of which all but the first are duplicates."""
    counted = stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", F.sha2("text", 256)))
    last = F.regexp_replace("text", SPACE + r"+\z", "")
    first = counted.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("f")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("f.turn").alias("t"))
    seen = counted.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    fault = F.when(F.length(last) == 0, "b").when(~F.col("turn").eqNullSafe(F.col("t")), "d").when(~F.substring(last, -1, 1).isin(".", "!", "?"), "t").otherwise("")
    by = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    sorted_rows = seen.select("conv_id", "turn", "role", "text", fault.alias("fault"), "n").repartitionByRange(*by).sortWithinPartitions(*by)
    piece = F.spark_partition_id()
    number = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    out = sorted_rows.withColumns({"piece": piece, "seq": number})
    return stored(out.withColumn("block", F.floor(F.col("seq") / block)))


STATS = ("blank", "duplicate", "truncated", "illegal")
TAIL = "cell array<struct<p: int, q: int, cost: long, audit: string>>, head string, tail string, n long, " + ", ".join(f"{c} long" for c in STATS)


def in_batches(rows: Iterator[tuple], types: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    """Rows as record batches, with `most` rows or about a million letters each."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or size > 1_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types.types, strict=True)], schema=types)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types.types, strict=True)], schema=types)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of sorted batches, some at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)


def flat(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cell.items()]


def streamed(rows: DataFrame, by: tuple, order: tuple, schema: str, make: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """`make` over the rows of each task, which holds all of the same `by`, in order."""
    dealt, types = rows.repartition(*by).sortWithinPartitions(*order), to_arrow_schema(StructType.fromDDL(schema))
    return dealt.mapInArrow(lambda batches: in_batches(make(rows_of(batches)), types), schema)


def fragments(rows: DataFrame) -> DataFrame:
    """placed rows → a fragment for each conversation, piece and block."""

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, part in groupby(rows, key=lambda r: r[:3]):
            own = [r[4:] for r in part]  # initial, fault, n
            n = sum(k for *_, k in own)
            blank = sum(k for _, f, k in own if f == "b")
            duplicate = sum(k - (f != "d") for _, f, k in own if f != "b")
            illegal = n - len(own) + sum(a[0] + b[0] not in LEGAL for a, b in pairwise(own))
            yield *key, flat(span(own)), own[0][0], own[-1][0], n, blank, duplicate, sum(f == "t" for _, f, _ in own), illegal

    narrow = rows.select("conv_id", "piece", "block", "seq", F.substring("role", 1, 1).alias("initial"), "fault", "n")
    return streamed(narrow, ("conv_id", "piece", "block"), ("conv_id", "piece", "block", "seq"), f"conv_id long, piece int, block long, {TAIL}", make)


def meet(numbered: DataFrame, fan: int) -> DataFrame:
    """(conv_id, nth, a fragment) → `fan` neighbours as one."""

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (conv, nth), part in groupby(rows, key=lambda r: (r[0], r[1] // fan)):
            own = list(part)
            cell = combined([{(x["p"], x["q"]): (x["cost"], x["audit"]) for x in r[2]} for r in own])
            seams = sum(a[4] + b[3] not in LEGAL for a, b in pairwise(own))
            n, blank, duplicate, truncated, illegal = (sum(r[k] for r in own) for k in range(5, 10))
            yield conv, nth, flat(cell), own[0][3], own[-1][4], n, blank, duplicate, truncated, illegal + seams

    return streamed(numbered, ("conv_id", F.floor(F.col("nth") / fan)), ("conv_id", "nth"), f"conv_id long, nth long, {TAIL}", make)


@dataclass
class Repair:
    """placed: the rows in order; parts: (conv_id, piece, block, n), n rows each; summary: a row for each conversation that has rows."""

    placed: DataFrame
    parts: DataFrame
    summary: DataFrame

    def slices(self) -> DataFrame:
        """(conv_id, piece, block, audit, state): each part's share of its conversation's audit, and the initial of the row before."""

        def make(rows: Iterator[tuple]) -> Iterator[tuple]:
            for conv, part in groupby(rows, key=lambda r: r[0]):
                audit, at, done, cut = next(part)[4], 0, 0, None
                odd = (len(audit) - audit.count("D")) % 2  # then a system row comes first
                for row in part:
                    if cut:
                        yield cut
                    start, left = at, row[3]
                    while left:
                        left -= audit[at] != "I"
                        at += 1
                    cut = (conv, row[1], row[2], audit[start:at], "" if not done else "s" if odd and done == 1 else "ua"[(done - odd) % 2 == 0])
                    done += at - start - audit.count("D", start, at)
                yield *cut[:3], cut[3] + audit[at:], cut[4]

        heads = self.summary.select("conv_id", F.lit(-1).alias("piece"), F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("n"), "audit")
        both = heads.unionByName(self.parts.withColumn("audit", F.lit(None).cast("string")))
        return streamed(both, ("conv_id",), ("conv_id", "piece", "block"), "conv_id long, piece int, block long, audit string, state string", make)

    def edits(self) -> DataFrame:
        """The parts' audits, each before its rows."""
        heads = self.slices().select("conv_id", "piece", "block", F.lit(-1).cast("long").alias("seq"), F.col("state").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("n"))
        return heads.unionByName(self.placed.select("conv_id", "piece", "block", "seq", "role", "text", "n"))

    def rows(self) -> DataFrame:
        """(conv_id, piece, block, number, edit, role, text): the repaired rows, in that order."""

        def make(rows: Iterator[tuple]) -> Iterator[tuple]:
            for key, part in groupby(rows, key=lambda r: r[:3]):
                for number, row in enumerate(edits_of(part)):
                    yield *key, number, *row

        return streamed(self.edits(), ("conv_id", "piece", "block"), ("conv_id", "piece", "block", "seq"), "conv_id long, piece int, block long, number long, edit string, role string, text string", make)

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256) of the repaired rows as role:text lines. A digest is made in order, so one task hashes a conversation, row by row, and holds none of it."""

        def make(rows: Iterator[tuple]) -> Iterator[tuple]:
            for conv, parts in groupby(rows, key=lambda r: r[0]):
                digest, between = hashlib.sha256(), b""
                for _, part in groupby(parts, key=lambda r: r[1:3]):
                    for _, role, text in edits_of(part):
                        digest.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                        between = b"\n"
                yield conv, digest.hexdigest()

        return streamed(self.edits(), ("conv_id",), ("conv_id", "piece", "block", "seq"), "conv_id long, repaired_sha256 string", make)


def edits_of(part: Iterator[tuple]) -> Iterator[tuple[str, str, str]]:
    """A part's rows, its audit first, as repaired."""
    *_, state, audit, _ = next(part)
    return edited(((role, text) for *_, role, text, n in part for _ in range(n)), audit, state)


def repair(rows: DataFrame, block: int = 4096, fan: int = 256) -> Repair:
    """rows(conv_id, turn, role, text) as strings without nulls but for conv_id and turn. Rows of one turn come by role, then text.

    summary: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. No rows give no conversations.
    """
    rows = placed(rows, block)
    parts = stored(fragments(rows))
    keys = parts.select("conv_id", "piece", "block")
    nth = (F.row_number().over(Window.partitionBy("conv_id").orderBy("piece", "block")) - 1).cast("long")
    named = keys.withColumn("nth", nth).select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), F.col("block").alias("b"), "nth")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")) & (F.col("block") == F.col("b"))
    whole = stored(parts.join(named, same).select("conv_id", "nth", "cell", "head", "tail", "n", *STATS))
    while whole.agg(F.max("nth")).first()[0]:
        whole = stored(meet(whole, fan))
    ends = F.filter("cell", lambda x: (x["p"] == START) & x["q"].isin(*ENDS))
    cheapest = F.array_min(F.transform(ends, lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"))))
    turns = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")).withColumnRenamed("conv_id", "c")
    summary = whole.withColumn("e", cheapest).join(turns, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "gaps", *STATS, "e.cost", "e.audit")
    return Repair(rows, parts.select("conv_id", "piece", "block", "n"), stored(summary))


def repair_damaged(conversations: DataFrame, conv_col: str = "conv_id", **columns: str) -> DataFrame:
    """Every conv_id of conversations, damaged and repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows without an id are one conversation. A conversation that the damage leaves without rows has zeros, an empty audit
    and the digest of an empty text. Repeated rows are duplicates of one another. Other columns are ignored.
    """
    done = repair(damaged(conversations, conv_col, **columns))
    c = lambda df, name: df.withColumnRenamed("conv_id", name)
    ids = conversations.select(F.col(conv_col).cast("long").alias("conv_id")).distinct()
    out = ids.join(c(done.summary, "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").join(c(done.digests(), "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left")
    zeros = [F.coalesce(x, F.lit(0)).alias(x) for x in ("gaps", *STATS, "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
