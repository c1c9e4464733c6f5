"""Cutting long texts: by headings, and by size. Lines are the atoms, so that both are folds over an array of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded_sections(text: Column, level: int = 2, least_words: int = 0) -> Column:
    """Array of (heading, content): the text cut at lines that are headings of `level` or deeper; what stands before the first has no heading.

    A section of under `least_words` words joins the next one, both headings with a slash between them; the last stays.
    """
    mark = r"#{%d,6}" % level
    parts = F.split(text, rf"(?m)(?=^{mark}\s)")  # each part but the first begins with its heading's line
    named = lambda p: p.rlike(rf"^{mark}\s")
    section = lambda p: F.struct(
        F.when(named(p), F.trim(F.regexp_extract(p, rf"^{mark}\s+([^\n]*)", 1))).otherwise("").alias("heading"),
        F.regexp_replace(F.when(named(p), F.regexp_replace(p, rf"^{mark}\s+[^\n]*\n?", "")).otherwise(p), r"^\s+|\s+\z", "").alias("content"),
    )
    cut = F.filter(F.transform(parts, section), lambda s: (s["heading"] != "") | (s["content"] != ""))
    if not least_words:
        return cut
    kind = "struct<done:array<struct<heading:string,content:string>>,last:struct<heading:string,content:string>>"
    both = lambda x, y, between: F.when(x == "", y).when(y == "", x).otherwise(F.concat(x, F.lit(between), y))
    short = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) < least_words

    def step(acc: Column, s: Column) -> Column:
        last = acc["last"]
        joined = F.struct(both(last["heading"], s["heading"], " / ").alias("heading"), both(last["content"], s["content"], "\n\n").alias("content"))
        grows = last.isNotNull() & short(last["content"])
        done = F.when(last.isNull() | grows, acc["done"]).otherwise(F.concat(acc["done"], F.array(last)))
        return F.struct(done.alias("done"), F.when(grows, joined).otherwise(s).alias("last")).cast(kind)

    start = F.struct(F.array().alias("done"), F.lit(None).alias("last")).cast(kind)
    return F.aggregate(cut, start, step, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))))


def heading_sections(df: DataFrame, id_col: str, text: str, least_words: int = 0, level: int = 2) -> DataFrame:
    """(id, section, heading, content), as folded_sections cuts the text; section: its place, from 0."""
    cut = df.select(id_col, F.posexplode(folded_sections(F.col(text), level, least_words)).alias("section", "s"))
    return cut.select(id_col, "section", "s.heading", "s.content")


def packed(df: DataFrame, id_col: str, text: str, most_tokens: int) -> DataFrame:
    """(id, chunk, content): paragraphs packed greedily up to most_tokens (a quarter of the characters); a paragraph above that is packed by its lines, and a line above it stands alone."""
    size = lambda c: F.floor(F.length(c) / 4 + 0.5)
    paragraphs = F.filter(F.transform(F.split(F.col(text), r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    atoms = F.flatten(F.transform(paragraphs, lambda p: F.when(size(p) > most_tokens, F.transform(F.split(p, "\n"), lambda l: F.struct(l.alias("t"), F.lit("\n").alias("j")))).otherwise(F.array(F.struct(p.alias("t"), F.lit("\n\n").alias("j"))))))  # noqa: E741

    kind = "struct<done:array<string>,last:string>"  # only a full chunk is put to the others

    def step(acc: Column, atom: Column) -> Column:
        whole = F.concat(acc["last"], atom["j"], atom["t"])
        first, full = acc["last"] == "", size(whole) > most_tokens
        done = F.when(first | ~full, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"])))
        return F.struct(done.alias("done"), F.when(first | full, atom["t"]).otherwise(whole).alias("last")).cast(kind)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("last")).cast(kind)
    end = lambda acc: F.when(acc["last"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"])))
    cut = df.select(id_col, F.aggregate(atoms, start, step, end).alias("c"))
    return cut.select(id_col, F.posexplode("c").alias("chunk", "content"))


def front_matter(text: Column) -> tuple[Column, Column]:
    """(body, map of fields): what stands between lines of --- at the top is cut off and read as fields."""
    head = F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---\s*\n", 1)
    lines = F.filter(F.split(head, "\n"), lambda line: line.contains(":"))
    field = lambda line: F.struct(F.trim(F.regexp_extract(line, "^([^:]*):", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1)), "^[\"']+|[\"']+$", "").alias("v"))
    entries = F.transform(lines, field)
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    # of fields with one name the last counts
    fields = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]))
    return F.regexp_replace(text, r"(?s)^---\s*\n.*?\n---\s*\n", ""), fields


# Starts of headings that are actions, and headings that list settings or a reference.
ACTIONS = ("how to ", "how do ", "when to ", "setting up ", "getting started", "creating ", "configuring ", "installing ", "working with ", "using ", "customizing ", "adding ", "removing ", "enabling ", "disabling ", "running ", "debugging ", "troubleshooting")
SETTINGS = ("settings", "configuration", "options", "environment variables", "config", "flags", "parameters", "keys", "values")
REFERENCE = ("commands", "reference", "api", "syntax", "spec", "schema")


def question(title: Column, heading: Column) -> Column:
    """A question that a section answers, by the form of its heading."""
    h = F.regexp_replace(F.trim(heading), r"\.+$", "")
    low = F.lower(h)
    return (
        F.when(h.endswith("?"), h).when(low.rlike("^(" + "|".join(ACTIONS) + ")"), F.concat(low, F.lit(", according to "), title, F.lit("?")))
        .when(low.isin(*SETTINGS), F.concat(F.lit("What are the "), low, F.lit(" of "), title, F.lit("?"))).when(low.isin(*REFERENCE), F.concat(F.lit("What is the "), low, F.lit(" of "), title, F.lit("?")))
        .otherwise(F.concat(F.lit("What does '"), h, F.lit("' mean in "), title, F.lit("?")))
    )


def rephrased(title: Column, heading: Column, level: Column) -> Column:
    """Another wording of a section's question, so that a held-out row can't be matched by its words."""
    h = F.regexp_replace(F.trim(heading), r"\.+$", "")
    return F.when(h.endswith("?"), F.concat(F.lit("On "), title, F.lit(": "), h)).when(level == 2, F.concat(F.lit("Explain '"), h, F.lit("' as "), title, F.lit(" has it."))).otherwise(F.concat(F.lit("Within "), title, F.lit(", describe what '"), h, F.lit("' covers.")))


def question_rows(df: DataFrame, id_col: str, text: str, title: Column, least_words: int = 40, navigation: str = r"(?i)^(next steps|see also|related.*|resources|further reading)$") -> DataFrame:
    """(id, row_id, section, level, title, heading, prompt, completion, words): a row for each section of level 2 or 3 of a markdown text, but navigation and sections of under least_words words. Deeper headings belong to the section above."""
    body, fields = front_matter(F.col(text))
    parts = F.split(F.col("_body"), r"(?m)(?=^#{2,3}[ \t])")
    rows = df.select(id_col, body.alias("_body"), F.coalesce(fields["title"], title).alias("title")).select(id_col, "title", F.posexplode(F.filter(parts, lambda p: p.rlike(r"^#{2,3}[ \t]"))).alias("section", "part"))
    rows = rows.select(
        id_col, "title", "section", F.length(F.regexp_extract("part", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("part", r"^#+[ \t]+([^\n]*)", 1)).alias("heading"),
        F.regexp_replace(F.regexp_replace("part", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("completion"),
    )
    rows = rows.withColumn("words", F.size(F.filter(F.split("completion", r"\s+"), lambda w: w != "")))
    key = F.concat(F.lit("q_"), F.substring(F.sha2(F.concat_ws("::", F.col(id_col).cast("string"), F.col("section").cast("string"), "heading"), 256), 1, 16))
    return rows.where((F.col("words") >= least_words) & ~F.col("heading").rlike(navigation)).select(id_col, key.alias("row_id"), "section", "level", "title", "heading", question(F.col("title"), F.col("heading")).alias("prompt"), "completion", "words")
