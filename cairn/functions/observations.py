"""What a noted text is worth: novelty of its terms, corrections, surprise, quality; and bringing it into shape: sanitising, compressing, cutting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intent import any_of
from .scalars import clamp, once

# Phrases of a correction; any of them scores 0.9.
CORRECTIONS = (
    r"\bno,?\s+(that'?s?\s+)?wrong\b", r"\bactually,?\s+(it'?s?\s+)?", r"\byou'?re\s+mistaken\b", r"\bcorrection:?\b", r"\bnot\s+\w+,?\s+but\s+\w+\b", r"\bthat'?s?\s+incorrect\b", r"\blet me correct\b", r"\bI meant\b",
)
# Endings of technical terms.
SUFFIXES = ("API", "SDK", "ORM", "DB", "Service", "Manager", "Handler")
# Vague words.
VAGUE = ("thing", "things", "stuff", "something", "somehow", "somewhere", "sometime", "maybe", "probably", "might", "basically", "essentially", "generally", "etc", "etc.", "whatever")
# What marks a path, beside a slash.
PATHS = (".go", ".py", ".ts", ".js", ".md", ".yaml", ".yml", ".json", "http://", "https://", "internal/", "cmd/")
# Kind of an observation → what it is worth to act on.
KINDS = {
    "correction": 0.5, "decision": 0.4, "error": 0.4, "blocker": 0.4, "task": 0.35, "preference": 0.3, "learning": 0.2, "insight": 0.2, "technical_note": 0.15,
    "progress": 0.1, "context": 0.1, "constraint": 0.5, "note": 0.1, "context_signal": 0.0, "self_improvement": 0.15,
}
# Words that call for action, and starts of imperatives.
VERBS = ("should", "must", "need to", "requires", "use ", "don't use", "always", "never", "instead of", "prefer", "avoid", "changed to", "switched to", "migrated", "fixed")
IMPERATIVES = ("use ", "add ", "remove ", "fix ", "update ", "change ", "set ", "configure ", "run ", "create ", "delete ")
# Words that point elsewhere.
REFERENCES = ("see ", "ref ", "related to", "depends on", "blocks ", "from session", "previously", "as discussed")
# Weights of specificity, actionability, context; of correction, terms, embedding, contradiction.
QUALITY_WEIGHTS = (0.40, 0.35, 0.25)
SURPRISE_WEIGHTS = (0.4, 0.25, 0.25, 0.1)
# Phrases that try to take over a prompt.
INJECTIONS = (
    "ignore previous instructions", "ignore all previous instructions", "ignore all prior instructions", "ignore your instructions", "disregard previous instructions", "disregard all previous instructions",
    "disregard your instructions", "forget your instructions", "forget all previous instructions", "override your instructions", "you are now", "you must now", "pretend you are", "act as if you are",
    "from now on you are", "new instructions:", "new system prompt:", "begin new conversation",
)
# Words that a telegram leaves out.
FILLERS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might",
    "shall", "can", "it", "its", "this", "that", "these", "those", "i", "you", "he", "she", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "our",
    "their", "myself", "yourself", "of", "in", "to", "for", "with", "on", "at", "by", "from", "as", "into", "about", "between", "through", "and", "but", "or", "so",
    "yet", "just", "also", "very", "really", "quite", "rather", "somewhat", "there", "here", "then", "now",
)


def fields(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _score(condition: Column, x: float) -> Column:
    return F.when(condition, x).otherwise(0.0)


def term_novelty(text: Column) -> Column:
    """Sum over words of 0.3 for mixed case, else 0.4 for an acronym, else 0.2 for a name of over five bytes with _ or -, else 0.25 for a technical ending, over the number of words; times 1.5 if over 30 % of them count; 1 at most."""

    def worth(word: Column) -> Column:
        of = lambda w: (
            F.when(F.octet_length(w) < 2, 0.0).when(w.rlike(r"\p{Lu}") & w.rlike(r"\p{Ll}"), 0.3).when(w.rlike(r"^\p{Lu}{2,}$"), 0.4)
            .when(w.rlike("[_-]") & (F.octet_length(w) > 5), 0.2).when(w.rlike("(" + "|".join(SUFFIXES) + ")$"), 0.25).otherwise(0.0)
        )
        return once(F.regexp_replace(word, r"^[^\p{L}\p{Nd}_-]+|[^\p{L}\p{Nd}_-]+$", ""), of)

    def total(scores: Column) -> Column:
        n = F.size(scores)
        mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / n
        many = F.size(F.filter(scores, lambda x: x > 0)) > 0.3 * n
        return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.when(many, mean * 1.5).otherwise(mean)))

    return once(F.transform(fields(text), worth), total)


def correction(text: Column) -> Column:
    """0.9 if the text corrects something, else 0."""
    return _score(text.rlike("(?i)(" + "|".join(CORRECTIONS) + ")"), 0.9)


def surprise(corrects: Column, terms: Column, embedding: Column, contradicts: Column) -> Column:
    return clamp(sum((w * x for w, x in zip(SURPRISE_WEIGHTS, (corrects, terms, embedding, contradicts), strict=True)), F.lit(0.0)))


def is_identifier(word: Column) -> Column:
    """A word like a name in code: a change of case within it, an underscore, or over five bytes with a dot."""
    of = lambda w: (F.octet_length(w) >= 2) & (w.rlike(r"\p{Ll}\p{Lu}|^.+\p{Lu}\p{Ll}") | (w.contains("_") & w.rlike(r"\p{Lu}|\p{Ll}")) | (w.contains(".") & w.rlike(r"\p{Ll}") & (F.octet_length(w) > 5)))
    return once(F.regexp_replace(word, r"""[.,;:!?()\[\]{}"'`]+$""", ""), of)


def specificity(text: Column) -> Column:
    """Length (0.1 from 5 words, 0.2 from 15, 0.3 from 30), share of identifiers (0.1 from 3 %, 0.2 from 8 %, 0.3 from 15 %), digits 0.1, path 0.15, quotes 0.1, less 0.15 if over 30 % are vague; 0 to 1."""
    path = text.contains("/") & (any_of(text, PATHS) | text.startswith("/"))

    def of(words: Column) -> Column:
        n = F.size(words)
        share = F.size(F.filter(words, is_identifier)) / n
        vague = F.size(F.filter(words, lambda w: F.regexp_replace(F.lower(w), "[.,;:!?]+$", "").isin(*VAGUE))) / n
        return F.when(n >= 30, 0.3).when(n >= 15, 0.2).when(n >= 5, 0.1).otherwise(0.0) + F.when(share >= 0.15, 0.3).when(share >= 0.08, 0.2).when(share >= 0.03, 0.1).otherwise(0.0) - _score(vague > 0.3, 0.15)

    return clamp(once(fields(text), of) + _score(text.rlike(r"\p{Nd}"), 0.1) + _score(path, 0.15) + _score(text.rlike("[\"'`]"), 0.1))


def actionability(text: Column, kind: Column) -> Column:
    """The kind's worth, 0.1 for a word that calls for action, 0.15 for an imperative start, 0.1 for a reason; 1 at most."""
    t = F.lower(text)
    worth = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), kind), F.lit(0.0))
    starts = t.rlike("^(" + "|".join(IMPERATIVES) + ")")
    return F.least(F.lit(1.0), worth + _score(any_of(t, VERBS), 0.1) + _score(starts, 0.15) + _score(any_of(t, ("because", "reason")), 0.1))


def context_richness(text: Column, n_tags: Column, n_fields: Column) -> Column:
    """Tags (0.15, from three 0.3), fields of metadata (0.1, from three 0.25), several lines 0.1, separators 0.1, references 0.1, bytes (0.1 from 100, 0.15 from 200); 1 at most."""
    size = F.octet_length(text)
    parts = (
        F.when(n_tags >= 3, 0.3).when(n_tags >= 1, 0.15).otherwise(0.0), F.when(n_fields >= 3, 0.25).when(n_fields >= 1, 0.1).otherwise(0.0), _score(text.contains("\n"), 0.1),
        _score(any_of(text, (": ", " -> ", " → ")), 0.1), _score(any_of(F.lower(text), REFERENCES), 0.1), F.when(size >= 200, 0.15).when(size >= 100, 0.1).otherwise(0.0),
    )
    return F.least(F.lit(1.0), sum(parts[1:], parts[0]))


def observation_quality(text: Column, kind: Column, n_tags: Column, n_fields: Column) -> Column:
    """A struct of specificity, actionability, context and their weighted sum."""
    parts = (specificity(text), actionability(text, kind), context_richness(text, n_tags, n_fields))
    total = sum((w * x for w, x in zip(QUALITY_WEIGHTS, parts, strict=True)), F.lit(0.0))
    return F.struct(*(x.alias(n) for n, x in zip(("specificity", "actionability", "context"), parts, strict=True)), F.least(F.lit(1.0), total).alias("overall"))


def cut_bytes(text: Column, most: int, suffix: str = "") -> Column:
    """The longest front of at most `most` bytes of UTF-8 that ends with a whole character, and the suffix if something was cut. No limit for 0 or less."""
    if most <= 0:
        return text

    raw = F.encode(text, "utf-8")
    whole = F.coalesce(*(F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(min(4, most + 1))))  # a character has four bytes at most
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(whole, F.lit(suffix)))


def sanitised(text: Column, most_bytes: int = 0, most_repeats: int = 5) -> Column:
    """Without lines that try to take over a prompt, that begin with a chat role or fence code; of lines that repeat the line before (but for white space around) `most_repeats` stay; cut to most_bytes."""
    dropped = lambda line: any_of(F.lower(line), INJECTIONS) | line.rlike(r"(?i)^\s*(human|assistant|system|user)\s*:") | line.rlike(r"^\s*`{3,}")
    kind = "struct<out:array<string>,last:string,n:int>"

    def step(acc: Column, line: Column) -> Column:
        trimmed = F.regexp_replace(line, r"^\s+|\s+$", "")
        n = F.when((trimmed == acc["last"]) & (trimmed != ""), acc["n"] + 1).otherwise(1)
        return F.struct(F.when(n > most_repeats, acc["out"]).otherwise(F.concat(acc["out"], F.array(line))).alias("out"), trimmed.alias("last"), n.cast("int").alias("n")).cast(kind)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"), F.lit(0).alias("n")).cast(kind)

    def joined(lines: Column) -> Column:
        # only texts in which a line stands more than most_repeats times in a row need the fold
        trimmed = F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
        repeats = once(trimmed, lambda t: F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - most_repeats)), lambda i: F.size(F.array_distinct(F.slice(t, i, most_repeats + 1))) == 1))
        folded = F.aggregate(lines, start, step, lambda acc: acc["out"])
        return F.array_join(F.when((F.size(lines) > most_repeats) & repeats, folded).otherwise(lines), "\n")

    out = once(F.filter(F.split(text, "\n"), lambda line: ~dropped(line)), joined)
    return cut_bytes(out, most_bytes, "...")


def telegraphic(text: Column) -> Column:
    """Words but fillers, with one space between; punctuation at a word's ends doesn't hide a filler."""
    filler = lambda w: F.regexp_replace(F.lower(w), r"""^[.,;:!?"']+|[.,;:!?"']+$""", "").isin(*FILLERS)
    return F.array_join(F.filter(fields(text), lambda w: ~filler(w)), " ")


def abbreviated(node_id: Column, most: int) -> Column:
    """The first `most` characters of an id."""
    return F.substring(node_id, 1, most)


def cut_at_word(text: Column, most: int) -> Column:
    """At most `most` bytes: cut at the last space before most - 3 and three dots put on; without such a space, within the word; under four bytes, just cut."""
    if most < 4:
        return cut_bytes(text, most)
    front = cut_bytes(text, most - 3)
    at = F.regexp_extract(front, r"(?s)^(.+) ", 1)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.when(at != "", at).otherwise(front), F.lit("...")))


def compact(text: Column, most: int) -> Column:
    return cut_at_word(telegraphic(text), most)


def path_prefix(path: Column, depth: int) -> Column:
    """The first `depth` segments of a path up to any #, joined; the whole path if it has no more, _unknown_ for an empty one."""
    segments = F.filter(F.split(F.regexp_extract(path, "^[^#]*", 0), "/"), lambda s: s != "")
    return F.when(F.coalesce(path, F.lit("")) == "", "_unknown_").otherwise(once(segments, lambda s: F.when(F.size(s) <= depth, path).otherwise(F.array_join(F.slice(s, 1, depth), "/"))))


# Class → file endings.
ENDINGS = {
    "go": ("go",), "typescript": ("ts", "tsx", "js", "jsx", "mjs", "cjs"), "python": ("py", "pyi"), "markdown": ("md", "mdx", "rst", "txt"), "config": ("yaml", "yml", "json", "toml", "ini", "env", "cfg"), "shell": ("sh", "bash", "zsh", "fish"),
    "query": ("sql", "cypher"), "rust": ("rs",), "jvm": ("java", "kt", "kts"), "cpp": ("c", "cpp", "cc", "h", "hpp"), "web": ("css", "scss", "less", "html", "svg"), "schema": ("proto", "graphql", "gql"), "container": ("dockerfile", "containerfile"),
}


def extension_class(path: Column) -> Column:
    """The class of the ending of a path's last segment, up to any #; other if there is none."""
    ending = F.regexp_extract(path, r"\.([^./#]*)(?:#[^./]*)?$", 1)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in ENDINGS.items() for e in v for x in (e, k))), ending), F.lit("other"))


def describe(value: Column, medium: float, strong: float) -> Column:
    return F.when(value >= strong, "Strong").when(value >= medium, "Moderate").otherwise("Weak")


def explained(c: dict[str, Column], reranked: Column | None = None, medium: float = 0.5, strong: float = 0.7) -> Column:
    """A struct: strength of the vector match, confidence (0 to 1), path (stages that contributed) and a sentence. c: vector, and any of activation, learning, path, comparison, config, temporal, hub, redundancy, stale; penalties are negative."""
    of = lambda n: c.get(n, F.lit(0.0))
    confidence = clamp(
        of("vector") + _score(of("activation") > 0.1, 0.1) + _score(of("learning") > 0.01, 0.05) + _score((of("path") > 0.01) | (of("comparison") > 0.01), 0.05) - _score(of("hub") < -0.1, 0.1) - _score(of("redundancy") < -0.1, 0.05)
    )
    stages = [F.lit("vector_recall"), *(F.when(of(n) > 0.01, s) for n, s in (("activation", "spreading_activation"), ("learning", "learning_edge"), ("path", "path_boost"), ("comparison", "comparison_boost"), ("config", "config_boost"), ("temporal", "temporal_boost")))]
    stages += [F.when(of("stale") < -0.01, "stale_reference"), F.when(F.lit(False) if reranked is None else reranked, "rerank")]
    path = F.array_compact(F.array(*stages))
    strength = describe(of("vector"), medium, strong)
    text = F.concat(strength, F.lit(" match by "), F.array_join(path, ", "))
    return F.struct(strength.alias("strength"), confidence.alias("confidence"), path.alias("path"), text.alias("text"))


def any_pattern(patterns: Sequence[str]) -> str:
    return "(?i)(" + "|".join(patterns) + ")"
