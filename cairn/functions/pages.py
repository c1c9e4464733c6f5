"""Web pages as text with marked headings, and their sections. All are column expressions; a page is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import folded_sections

#: Elements whose text is not a page's own.
LEFT_OUT = ("script", "style", "nav", "footer", "head", "template")
BLOCKS = "p|br|tr|div|ul|ol|table|article|section|main|blockquote|dl|dt|dd|hr"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
STOP = ("about", "after", "also", "and", "are", "but", "can", "for", "from", "have", "into", "not", "that", "the", "their", "then", "this", "use", "using", "was", "were", "when", "will", "with", "you", "your")


def without(text: Column, opening: str, closing: str) -> Column:
    """The text without what stands from each match of `opening` to the next of `closing`, or to the next `opening` or the end. Each place is read once."""
    rest = lambda p: F.coalesce(F.get(F.split(p, closing, 2), F.lit(1)), F.lit(""))
    return F.array_join(F.transform(F.split(text, opening), lambda p, i: F.when(i == 0, p).otherwise(rest(p))), "")


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?i)<title[^<>]*>([^<]*)", 1))


def page_text(html: Column) -> Column:
    """Blocks as lines, headings with as many # as their level, list items with a dash, code between fences with its language; null for null."""
    s = without(html, "<!--", "-->")
    for name in LEFT_OUT:
        s = without(s, rf"(?i)<{name}\b", rf"(?i)</{name}\s*>")
    s = F.regexp_replace(s, r"""(?i)<pre[^<>]*>\s*<code[^<>]*class=["'][^"'<>]*language-(\w+)[^<>]*>""", "\n```$1\n")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)</?pre\b[^<>]*>", "\n```\n"), r"(?i)<li\b[^<>]*>", "\n- ")
    for level in range(1, 7):
        s = F.regexp_replace(s, rf"(?i)<h{level}\b[^<>]*>", "\n" + "#" * level + " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)</h[1-6]\s*>", "\n"), rf"(?i)</?({BLOCKS})\b[^<>]*>", "\n")
    s = F.regexp_replace(s, r"</?[a-zA-Z][^<>]*>", "")
    for entity, char in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(char))
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t\r]+", " "), " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(s, "\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


def key_terms(text: Column, most: int) -> Column:
    """The first `most` distinct words of four letters or more that are no stop words, lower-cased."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*STOP))), 1, most)


def section_tags(content: Column, heading: Column, domain: Column, base: tuple[str, ...] = (), most: int = 5) -> Column:
    """Base tags, lang: of each fence's language, domain: of the page, topic: of the headings' key terms, each once."""
    langs = F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^```(\w+)[ \t]*$"), F.lit(1)), lambda x: F.concat(F.lit("lang:"), F.lower(x)))
    inner = F.array_join(F.regexp_extract_all(content, F.lit(r"(?m)^#{1,6}\s+(.+)$"), F.lit(1)), " ")
    topics = F.transform(key_terms(F.concat_ws(" ", heading, inner), most), lambda x: F.concat(F.lit("topic:"), x))
    site = F.when(F.coalesce(domain, F.lit("")) != "", F.array(F.concat(F.lit("domain:"), domain))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(*map(F.lit, base)).cast("array<string>"), langs, site, topics))


def page_sections(pages: DataFrame, id_col: str, url: str, html: str, least_page: int = 100, least_words: int = 20, level: int = 2, base: tuple[str, ...] = ()) -> DataFrame:
    """(id, section, title, content, words, tags, chunked): pages of at least least_page words cut at headings of `level` or deeper, sections of under least_words words joined to the next; shorter pages whole, with their own title.

    A null page, or one without text, has one empty section.
    """
    domain = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    p = pages.select(F.col(id_col), domain.alias("domain"), page_title(F.coalesce(F.col(html), F.lit(""))).alias("page_title"), page_text(F.coalesce(F.col(html), F.lit(""))).alias("text"))
    count = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    p = p.withColumn("chunked", count(F.col("text")) >= least_page)
    whole = F.array(F.struct(F.col("page_title").alias("heading"), F.col("text").alias("content")))
    cut = p.select(id_col, "domain", "chunked", F.posexplode(F.when(F.col("chunked"), folded_sections(F.col("text"), level, least_words)).otherwise(whole)).alias("section", "s"))
    content, heading = F.col("s.content"), F.col("s.heading")
    return cut.select(id_col, "section", heading.alias("title"), content.alias("content"), count(content).alias("words"), section_tags(content, heading, F.col("domain"), base).alias("tags"), "chunked")
