"""I-Match fingerprints with DataFrame functions only.

Terms whose inverse document frequency lies in a band form the lexicon; a document's distinct terms of the lexicon are
sorted, and hashed for each of several randomised subsets of the lexicon. Subsets come in scales: in the k-th of a scale
of one in m stand the terms whose hash is k modulo m, for k below `per_scale`. Coarse subsets tell apart, fine ones still
agree when part of a text changes. The lexicon is broadcast: a term of it stands in a share of 1 / e^idf_high of all
documents at least, so that there are at most e^idf_high times the mean number of distinct terms, at any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SPLIT = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Lexicon:
    """idf = ln(documents / documents with the term); scales: m of each scale; digits: hexadecimal ones of a subset's hash; max_broadcast: rows of a lexicon, or of bounds, up to which they are broadcast, else joined by shuffle; bucket: rows put in sequence together; cells: quantiles of ids from which buckets are cut."""

    idf_low: float = 1.5
    idf_high: float = 8.0
    least_documents: int = 2
    scales: tuple[int, ...] = (16, 64, 256, 1024, 4096)
    per_scale: int = 16
    digits: int = 4
    max_broadcast: int = 3_000_000
    bucket: int = 1000
    cells: int = 4096


def terms(text: Column) -> Column:
    """Hashes of the distinct words of a text, lower-cased in A-Z."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.array_remove(F.array_distinct(F.split(lowered, SPLIT)), ""), lambda w: F.xxhash64(w))


def lexicon(texts: DataFrame, rules: Lexicon) -> DataFrame:
    """texts(text) → (term) in the band, over all rows."""
    n = texts.agg(F.count("*").alias("n"))
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= rules.least_documents)
    idf = F.log(F.col("n") / F.col("df"))
    return counts.crossJoin(F.broadcast(n)).where(idf.between(rules.idf_low, rules.idf_high)).select("term")  # one row beside each count


def once(value: Column, use) -> Column:
    """use(value), value being computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def signature(hashes: Column, rules: Lexicon) -> Column:
    """An array with the hash of each subset, scale by scale; -1 where no term of the document is in it. hashes: sorted, distinct."""

    def scale(m: int) -> Column:
        empty = F.xxhash64(F.array().cast("array<bigint>"), F.lit(m))
        subsets = F.sequence(F.lit(0), F.lit(rules.per_scale - 1))
        own = lambda near: F.transform(subsets, lambda k: F.xxhash64(F.filter(near, lambda t: F.pmod(t, F.lit(m)) == k), F.lit(m)))
        digests = once(F.filter(hashes, lambda t: F.pmod(t, F.lit(m)) < rules.per_scale), own)
        return F.transform(digests, lambda h: F.when(h == empty, -1).otherwise(h.bitwiseAND(F.lit(16**rules.digits - 1)).cast("int")))

    return F.concat(*map(scale, rules.scales))


def fingerprint(hashes: Column, sig: Column, rest: Column, rules: Lexicon) -> Column:
    """The signature as hexadecimal digits, dashes for an empty subset; without terms of the lexicon, a hash of all terms."""
    d = rules.digits
    digits = F.array_join(F.transform(sig, lambda v: F.when(v < 0, "-" * d).otherwise(F.lpad(F.hex(v), d, "0"))), "")
    return F.when(F.size(hashes) > 0, digits).otherwise(F.concat(F.lit("none:"), F.hex(rest)))


def likeness(a: Column, b: Column, rules: Lexicon) -> Column:
    """Of two signatures: the largest share of equal subsets over the scales with four or more subsets filled on either side, or the share over all scales if that is larger."""
    per, n = rules.per_scale, len(rules.scales)
    codes = F.zip_with(a, b, lambda x, y: F.when((x < 0) & (y < 0), 0).when(x == y, 2).otherwise(1))

    def shares(c: Column) -> Column:
        count = lambda part, least: F.size(F.filter(part, lambda v: v >= least))
        own = [F.when(count(s, 1) >= 4, count(s, 2) / count(s, 1)).otherwise(0.0) for s in (F.slice(c, i * per + 1, per) for i in range(n))]
        return F.greatest(*own, F.when(count(c, 1) > 0, count(c, 2) / count(c, 1)).otherwise(0.0))

    return once(codes, shares)


def cell_of(bounds: list[int]) -> Column:
    """Where doc_id stands among sorted bounds, the last being the largest id: 2k between the k-th and the one before, 2k + 1 on the k-th, -1 for null. Bounds are looked up in groups of 64."""
    groups = [bounds[i : i + 64] for i in range(0, len(bounds), 64)]
    longs = lambda x: F.array(*(F.lit(int(v)).cast("bigint") for v in x))
    below = lambda x: F.size(F.filter(x, lambda b: b < F.col("doc_id")))
    table = F.array(*map(longs, groups))

    def inner(j: Column) -> Column:
        return once(F.element_at(table, j + 1), lambda g: once(below(g), lambda i: (j * 64 + i) * 2 + F.when(F.element_at(g, i + 1) == F.col("doc_id"), 1).otherwise(0)))

    return F.when(F.col("doc_id").isNull(), -1).otherwise(once(below(longs([g[-1] for g in groups])), inner)).cast("long")


def in_sequence(docs: DataFrame, rules: Lexicon) -> DataFrame:
    """docs(doc_id, text) → with bucket, nth, guest, next_text: each document with the next in descending doc_id, after the last the first.

    Buckets are parts of cells, which quantiles of the ids bound, so that neither an outlying id nor one that many rows
    share fills one: rows of a single id, and those without, are parted by the hash of their text. The first document of
    a bucket is also a guest at the end of the bucket before it, so that one shuffle by bucket brings neighbours
    together. Rows with one id follow each other by hash and text; null ids are last.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("hash", F.xxhash64("text"))
    n = docs.count()
    share = [k / max(1, min(rules.cells, n // rules.bucket)) for k in range(1, max(1, min(rules.cells, n // rules.bucket)))]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, share)) if share else F.array(F.lit(1.0)), F.lit(20_000)).alias("q"), F.max("doc_id").alias("top")).first()  # `cells` numbers
    bounds = sorted({*(found.q or []), found.top}) if found.top is not None else [0]
    placed = docs.withColumn("cell", cell_of(bounds))
    cells, base = [], 0
    for r in sorted(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect(), key=lambda r: r.cell):  # two a bound at most
        parts = -(-r.n // rules.bucket)
        cells.append((r.cell, base, parts, r.low, None if r.low == r.high else float(r.high - r.low + 1)))
        base += parts
    table = F.broadcast(spark.createDataFrame(cells, "cell long, base long, parts long, low long, width double"))
    # a hash goes up where buckets go down
    by_hash = F.col("parts") - 1 - F.floor(F.shiftrightunsigned(F.col("hash").bitwiseXOR(F.lit(-(2**63))), 33) / F.lit(float(2**31)) * F.col("parts"))
    part = F.when(F.col("width").isNull(), by_hash).otherwise(F.least(F.col("parts") - 1, F.floor((F.col("doc_id") - F.col("low")) / F.col("width") * F.col("parts"))))
    own = placed.join(table, "cell").withColumn("bucket", (F.col("base") + part).cast("long")).select("bucket", "doc_id", "hash", "text")
    order = Window.orderBy("bucket")  # over a row a bucket
    first = F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), F.bitwise_not("hash").alias("h"))).alias("first")
    tops = own.groupBy("bucket").agg(first).select(F.col("bucket").alias("_b"), F.col("first.i").alias("_i"), F.bitwise_not("first.h").alias("_h"), F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(Window.partitionBy())).alias("host"))
    tops = F.broadcast(tops) if base <= rules.max_broadcast else tops
    visits = own.join(tops, (F.col("bucket") == F.col("_b")) & (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("_i")) & (F.col("hash") == F.col("_h")), "left")
    stays, visit = F.struct(F.col("bucket").alias("at"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("at"), F.lit(True).alias("guest"))
    placed = visits.withColumn("p", F.explode(F.when(F.col("host").isNull(), F.array(stays)).otherwise(F.array(stays, visit))))
    placed = placed.select(F.col("p.at").alias("bucket"), F.col("p.guest").alias("guest"), "doc_id", "hash", "text")
    line = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "hash", "text")
    return placed.select("bucket", "guest", "doc_id", "text", F.row_number().over(line).alias("nth"), F.lead("text").over(line).alias("next_text"))


def fingerprints(docs: DataFrame, rules: Lexicon = Lexicon(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Edited: the last third of the code points, rounded down, is replaced by as many from the front of the next document
    (all, if it is shorter). A null text is empty. Equal texts have equal fingerprints and a likeness of 1; a text without
    terms of the lexicon is like its equals only. Lexicon and sequence are taken over all rows. Repeated rows are each
    fingerprinted; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    band = stored(lexicon(docs, rules))
    bounded = F.broadcast(band) if band.count() <= rules.max_broadcast else band  # beyond the bound a shuffled join does it
    n, third = F.length("text"), F.floor(F.length("text") / 3)
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 3) as int))"))
    both = in_sequence(docs, rules).select("bucket", "nth", "guest", "doc_id", n.cast("long").alias("n_chars"), "text", F.when(~F.col("guest"), F.when(third > 0, edited).otherwise(F.col("text"))).alias("edited"))
    cut = both.select("bucket", "nth", "guest", "doc_id", "n_chars", F.sha2("edited", 256).alias("sha"), terms(F.col("text")).alias("t0"), terms(F.coalesce("edited", F.lit(""))).alias("t1"))
    # a term with the sides that have it: 1 the text, 2 the edited text, 3 both; and one row without a term for each document
    marked = F.concat(
        F.array(F.struct(F.lit(None).cast("bigint").alias("term"), F.lit(0).alias("side"))),
        F.transform("t0", lambda t: F.struct(t.alias("term"), F.lit(1).alias("side"))),
        F.transform("t1", lambda t: F.struct(t.alias("term"), F.lit(2).alias("side"))),
    )
    rest = lambda c: F.xxhash64(F.sort_array(c))
    once_each = cut.select("*", rest("t0").alias("rest0"), rest("t1").alias("rest1"))
    rows = once_each.select("bucket", "nth", "guest", "doc_id", "n_chars", "sha", "rest0", "rest1", F.explode(marked).alias("m")).select("*", "m.*").drop("m")
    known = rows.join(bounded.select(F.col("term").alias("known")), F.col("term") == F.col("known"), "left").where("known is not null or side = 0")
    side = lambda k: F.sort_array(F.collect_set(F.when(F.col("side") == k, F.col("term"))))
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    sets = known.groupBy("bucket", "nth").agg(*map(first, ("guest", "doc_id", "n_chars", "sha", "rest0", "rest1")), side(1).alias("h0"), side(2).alias("h1"))
    signed = sets.select("*", signature(F.col("h0"), rules).alias("s0"), signature(F.col("h1"), rules).alias("s1"))
    named = signed.select("bucket", "nth", "guest", "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), "s0", "s1", fingerprint(F.col("h0"), F.col("s0"), F.col("rest0"), rules).alias("fingerprint"), fingerprint(F.col("h1"), F.col("s1"), F.col("rest1"), rules).alias("edited_fingerprint"))
    line = Window.partitionBy("bucket").orderBy("nth")
    ahead = named.select("*", F.lead("s0").over(line).alias("s2"), F.lead("fingerprint").over(line).alias("next_fingerprint"))
    near = lambda f, s: F.when(F.col("fingerprint") == F.col(f), 1.0).when(F.col("fingerprint").startswith("none:") | F.col(f).startswith("none:"), 0.0).otherwise(likeness(F.col("s0"), F.col(s), rules))
    return ahead.where("not guest").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint", "s1").alias("near_edited"), near("next_fingerprint", "s2").alias("near_next"))
