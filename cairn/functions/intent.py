"""What a search query asks for, as columns: its class, retrieval hints, score gates, path and comparison hints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists, matched as plain substrings of the lower-cased query, even where they look like patterns.
CODE = (
    " class", "class ", " function", "function ", " method", "method ", " struct", "struct ", " interface", "interface ", " def ", "def ",
    "implementation of", "defined in", "definition of", "where is .* defined", "where is .* located", " source code", "signature", "parameters", "return type",
)
CODE_EDGES = ("class", "function", "method", "struct", "interface")
ARCHITECTURE = ("architecture", "design", "pattern", "structure", "overview", "module", "service", "component", "layer", "system", "workflow", "responsibility", "concern", "abstraction")
RELATIONSHIP = (
    "relationship between", "interact", "dependency", "depends on", "calls", "invokes", "connects to", "linked to", "references", "uses", "imports", "requires", "communicates with",
    "coupling", "integration", "interface between", "how does .* connect", "how does .* interact", "what calls", "what uses", "what depends",
)
DATA_FLOW = (
    "data flow", "data flows", "flows through", "passed to", "transforms", "transformation", "pipeline", "processing", "input", "output", "request", "response", "payload",
    "how is .* processed", "where does .* come from", "what happens to", "path of", "journey of", "state", "propagate", "dispatch", "emit", "publish", "subscribe", "event", "message", "queue",
)
SYMBOL = ("where is", "find", "locate", "show me", "definition of", "implementation of", "what file", "which file", "in what file")
SYMBOL_NAME = r"[a-z]+[A-Z][a-zA-Z]*|[a-z]+_[a-z]+"
CODE_TAGS = ("python", "go", "rust", "java", "typescript", "javascript", "c", "cpp", "csharp", "ruby", "php", "scala", "kotlin", "swift")
# Class → (seeds, hops, vector weight, BM25 weight, expands, edge strategy); the first class that fits wins.
HINTS = {
    "symbol_lookup": (30, 1, 0.85, 0.15, False, "structural_first"),
    "code": (40, 1, 0.75, 0.25, True, "structural_first"),
    "relationship": (60, 2, 0.6, 0.4, True, "hybrid"),
    "data_flow": (50, 2, 0.65, 0.35, True, "hybrid"),
    "architecture": (60, 2, 0.55, 0.45, True, "hybrid"),
    "generic": (50, 2, 0.5, 0.5, True, "hybrid"),
}
# Class → factors of vector, BM25 and activation weight, and the concept boost.
GATES = {"code": (1.3, 0.7, 0.7, 0.85), "architecture": (0.85, 1.3, 1.2, 1.25), "generic": (1.0, 1.0, 1.0, 1.0)}


def any_of(text: Column, keys: Sequence[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | text.contains(k)
    return out


def is_code(q: Column) -> Column:
    t = F.lower(q)
    out = any_of(t, CODE)
    for k in CODE_EDGES:
        out = out | t.endswith(k) | t.startswith(k + " ")
    return out


def is_architecture(q: Column) -> Column:
    return any_of(F.lower(q), ARCHITECTURE)


def query_class(q: Column) -> Column:
    """symbol_lookup, code, relationship, data_flow, architecture or generic."""
    t = F.lower(q)
    return (
        F.when(any_of(t, SYMBOL) | q.rlike(SYMBOL_NAME), "symbol_lookup").when(is_code(q), "code").when(any_of(t, RELATIONSHIP), "relationship")
        .when(any_of(t, DATA_FLOW), "data_flow").when(is_architecture(q), "architecture").otherwise("generic")
    )


def _lookup(key: Column, table: dict[str, tuple], at: int) -> Column:
    return F.element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v[at])))), key)


def retrieval_hints(q: Column) -> Column:
    """A struct of the class and its hints."""
    k = query_class(q)
    names = ("seeds", "hops", "vector_weight", "bm25_weight", "expand", "edges")
    return F.struct(k.alias("kind"), *(_lookup(k, HINTS, i).alias(n) for i, n in enumerate(names)))


def query_gates(q: Column, alpha: float = 0.55, bm25: float = 0.1, beta: float = 0.25) -> Column:
    """A struct of the gate's class and the weights after it. Gates know only code, then architecture."""
    k = F.when(is_code(q), "code").when(is_architecture(q), "architecture").otherwise("generic")
    return F.struct(k.alias("kind"), *((w * _lookup(k, GATES, i)).alias(n) for i, (n, w) in enumerate((("vector_weight", alpha), ("bm25_weight", bm25), ("activation_weight", beta), ("concept_boost", 1.0)))))


def code_type_boost(tags: Column, code_query: Column) -> Column:
    """For code queries config files count half and documentation 0.7; any code tag lifts that."""
    has = lambda *t: F.arrays_overlap(tags, F.array(*map(F.lit, t)))
    return F.when(~code_query | has(*CODE_TAGS), 1.0).when(has("config", "configuration"), 0.5).when(has("documentation", "markdown"), 0.7).otherwise(1.0)


def path_score(path: Column, hints: Column) -> Column:
    """The best over the hints: 0.5 + half the share of the path that a contained hint covers, else 0.3 times the share of the hint's segments that meet one of the path's."""
    p = F.lower(path)

    def one(h: Column) -> Column:
        parts, own = F.split(h, "/"), F.split(p, "/")
        met = F.size(F.filter(parts, lambda x: F.exists(own, lambda y: y.contains(x) | x.contains(y))))
        return F.when(p.contains(h), 0.5 + 0.5 * F.length(h) / F.length(p)).otherwise(0.3 * met / F.size(parts))

    return F.when((F.size(hints) > 0) & (F.length(p) > 0), F.array_max(F.transform(hints, one))).otherwise(0.0)


# Words that turn a statement round.
NEGATIONS = ("not", "never", "no", "instead of", "rather than", "avoid", "don't", "without")


def negation_differs(a: Column, b: Column) -> Column:
    """One text has a negation word that the other lacks; single words count as whole words only."""
    has = lambda t, m: F.lower(t).contains(m) if " " in m else F.lower(t).rlike(rf"(^|[^a-z0-9_']){m}($|[^a-z0-9_'])")
    out = F.lit(False)
    for m in NEGATIONS:
        out = out | (has(a, m) != has(b, m))
    return out


def symbol_specificity(kind: Column, name: Column, value: Column, exported: Column, doc: Column) -> Column:
    """0.5, plus 0.2 for a constant (0.2 more for a number other than 0 and 1), 0.15 for ALL_CAPS, 0.1 each for exported, enum value and documented; 1 at most."""
    bit = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    const = kind == "const"
    number = const & value.rlike(r"^\d+$") & ~value.isin("0", "1")
    total = 0.5 + bit(const, 0.2) + bit(number, 0.2) + bit(name.rlike("^[A-Z0-9_]{2,}$") & name.contains("_"), 0.15) + bit(exported, 0.1) + bit(kind == "enum_value", 0.1) + bit(F.coalesce(doc, F.lit("")) != "", 0.1)
    return F.least(F.lit(1.0), total)


def canonical_date(text: Column, scan: int | None = 500) -> Column:
    """The first valid date of, in turn: a changelog heading, a version line, a metadata field, any ISO date, within the first `scan` characters, or the whole text for None."""
    head = text if scan is None else F.substring(text, 1, scan)
    patterns = (r"(?m)^#+\s*\[[^\]]+\]\s*-\s*(\d{4}-\d{2}-\d{2})", r"(?i)version\s+[\d.]+\s*\((\d{4}-\d{2}-\d{2})\)", r"(?im)^\s*(?:date|published|updated|created)\s*:\s*(\d{4}-\d{2}-\d{2})", r"\b(\d{4}-\d{2}-\d{2})\b")
    return F.coalesce(*(F.try_to_timestamp(F.nullif(F.regexp_extract(head, p, 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date") for p in patterns))


# --- time -----------------------------------------------------------------------------------------------------------

# Names of months, and words of a wish for what is recent.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
RECENT = ("recent", "recently", "latest", "newest", "what changed", "what's new", "whats new", "updates to", "updated", "new changes", "latest changes", "recent changes")
DAY = r"(\d{4}-\d{2}-\d{2})"


def temporal_intent(q: Column, now: Column) -> Column:
    """A struct (mode, after, before, confidence): hard with a half-open range where the query names one, soft for words of recency, else none. The first pattern that gives a valid range counts."""
    none = F.lit(None).cast("timestamp")
    found = lambda p, i: F.regexp_extract(q, "(?i)" + p, i)
    date = lambda text: F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("yyyy-MM-dd"))
    month = lambda name, year: F.try_to_timestamp(F.when(name != "", F.concat(F.initcap(F.substring(name, 1, 3)), F.lit(" "), year)), F.lit("MMM yyyy"))

    def ago(p: str) -> Column:
        days = found(p, 1).try_cast("int") * F.when(F.lower(found(p, 2)).startswith("week"), 7).when(F.lower(found(p, 2)).startswith("month"), 30).otherwise(1)
        return F.when(found(p, 2) != "", now - F.make_interval(days=days))

    says = lambda p: q.rlike("(?i)" + p)
    since, before, between = rf"\bsince\s+{DAY}\b", rf"\bbefore\s+{DAY}\b", rf"\bbetween\s+{DAY}\s+and\s+{DAY}\b"
    since_month, before_month = rf"\bsince\s+({MONTHS})\s+(\d{{4}})\b", rf"\bbefore\s+({MONTHS})\s+(\d{{4}})\b"
    ranges = (
        (ago(r"\b(?:in\s+)?the\s+last\s+(\d+)\s+(days?|weeks?|months?)\b"), none), (ago(r"\blast\s+(\d+)\s+(days?|weeks?|months?)\b"), none),
        (F.when(says(r"\bthis\s+week\b"), F.date_trunc("week", now)), none), (F.when(says(r"\bthis\s+month\b"), F.date_trunc("month", now)), none), (F.when(says(r"\bthis\s+year\b"), F.date_trunc("year", now)), none),
        (F.when(says(r"\blast\s+week\b"), now - F.make_interval(days=F.lit(7))), none), (F.when(says(r"\blast\s+month\b"), now - F.make_interval(months=F.lit(1))), none),
        (date(found(since, 1)), none), (month(found(since_month, 1), found(since_month, 2)), none), (none, date(found(before, 1))), (none, month(found(before_month, 1), found(before_month, 2))),
        (F.when(date(found(between, 2)).isNotNull(), date(found(between, 1))), date(found(between, 2))),
    )
    kind = "struct<mode:string,after:timestamp,before:timestamp,confidence:double>"
    of = lambda mode, a, b, c: F.struct(F.lit(mode).alias("mode"), a.alias("after"), b.alias("before"), F.lit(c).alias("confidence")).cast(kind)
    hard = [F.when(a.isNotNull() if i < len(ranges) - 1 and b is none else b.isNotNull() if i < len(ranges) - 1 else a.isNotNull() & b.isNotNull(), of("hard", a, b, 0.9)) for i, (a, b) in enumerate(ranges)]
    words = sum((F.when(F.lower(q).contains(w), 1).otherwise(0) for w in RECENT[1:]), F.when(F.lower(q).contains(RECENT[0]), 1).otherwise(0))
    return F.coalesce(*hard, F.when(words > 1, of("soft", none, none, 0.85)).when(words == 1, of("soft", none, none, 0.7)), of("none", none, none, 0.0))


def in_range(at: Column, after: Column, before: Column) -> Column:
    """after <= at < before; a bound that is null doesn't count. A null time is outside unless both are null."""
    return F.coalesce(at >= after, after.isNull()) & F.coalesce(at < before, before.isNull())


# --- comparison -----------------------------------------------------------------------------------------------------

# How a query compares two things.
COMPARISONS = (
    r"\b(?:difference|differences)\s+between\s+(.+?)\s+and\s+(.+?)\b", r"\b(.+?)\s+(?:vs\.?|versus|compared\s+to)\s+(.+?)\b", r"\b(?:both|having both)\s+(.+?)\s+and\s+(.+?)\b",
    r"\b(?:compare|comparing)\s+(.+?)\s+(?:and|with|to)\s+(.+?)\b", r"\bwhy\s+(?:have|are there|do we have)\s+both\s+(.+?)\s+and\s+(.+?)\b", r"\brelationship\s+between\s+(.+?)\s+and\s+(.+?)\b",
)


def is_comparison(q: Column) -> Column:
    return q.rlike("(?i)" + "|".join(COMPARISONS))


def comparison_targets(q: Column) -> Column:
    """The names that a query compares, lower-cased, each once, in order: of each phrase without article and kind the last word that looks like a module, else the last word; over two characters."""

    def name(phrase: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.trim(phrase), r"(?i)^(?:the\s+)?", ""), r"(?i)\s*(?:module|service|controller|handler)s?\s*$", "")
        words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
        modules = F.filter(words, lambda w: w.rlike(r"^[A-Z][a-zA-Z0-9]+$|Module|Service"))
        return F.coalesce(F.try_element_at(modules, F.lit(-1)), F.try_element_at(words, F.lit(-1)), bare)

    phrases = F.concat(*(F.regexp_extract_all(q, F.lit("(?i)" + p), F.lit(i)) for p in COMPARISONS for i in (1, 2)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(phrases, lambda p: F.lower(name(p))), lambda t: F.length(t) > 2)))


def comparison_score(name: Column, summary: Column, tags: Column, targets: Column) -> Column:
    """0.1 + 0.1 times the share of targets that name or summary mention, 0.3 + 0.3 times it for a node tagged comparison; 0 if they mention none."""
    n, s = F.lower(name), F.lower(summary)
    share = F.size(F.filter(targets, lambda t: n.contains(t) | s.contains(t))) / F.size(targets)
    return F.when((F.size(targets) == 0) | (share == 0), 0.0).when(F.array_contains(tags, "comparison"), 0.3 + 0.3 * share).otherwise(0.1 + 0.1 * share)
