"""Column expressions of ranking, learning and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use) -> Column:
    """use(value), value being computed once however often it is used; inside a lambda it would be computed for each element."""
    return F.transform(F.array(value), use)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if the lengths differ, either is empty, or a norm is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hebbian(w: Column, a: Column, b: Column, eta: float = 0.02, mu: float = 0.01, low: float = 0.0, high: float = 1.0) -> Column:
    """(1 - mu) w + eta a b, softly capped at high and floored at low."""
    raw = (1 - mu) * w + eta * a * b
    return F.greatest(F.lit(low), high * F.tanh(raw / high))


def phase_multiplier(edges: Column) -> Column:
    return F.when(edges <= 0, 2.0).when(edges < 10_000, 1.0).when(edges < 50_000, 0.5).otherwise(0.25)


def kind_multiplier(kind: Column) -> Column:
    """How much faster an edge of that origin is learned."""
    return F.when(kind == "conversation", 2.0).when(kind == "config", 1.5).when(kind == "same_directory", 1.2).otherwise(1.0)


def learning_phase(edges: Column) -> Column:
    return F.when(edges <= 0, "cold").when(edges < 10_000, "learning").when(edges < 50_000, "warm").otherwise("saturated")


def session_proximity(seconds: Column) -> Column:
    return F.greatest(F.lit(0.1), 1 - 0.9 * seconds / 3600)


def hop_decay(hops: Column) -> Column:
    return F.when(hops <= 1, 1.0).otherwise(F.pow(F.lit(0.5), hops - 1))


def edge_decay(w: Column, days: Column, rate: float) -> Column:
    return w * F.exp(-rate * days)


def evidence_decay(w: Column, days: Column, evidence: Column, surprise: Column, rate: float) -> Column:
    return w * F.pow(1 - F.least(F.lit(1.0), rate / F.sqrt(F.greatest(evidence * surprise, F.lit(1e-9)))), days)


def confidence(n: Column, age_days: Column, variance: Column, alpha: float = 0.5, beta: float = 0.3, gamma: float = 1.0, tau: float = 30.0) -> Column:
    return clamp(sigmoid(alpha * F.log1p(n) + beta * F.exp(-age_days / tau) - gamma * variance), 0.05, 1.0)


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4 + 0.5)


def normalized_time(text: Column, kind: Column) -> Column:
    """rfc3339, unix, unix_ms and date_only to a timestamp; null for others."""
    return (
        F.when(kind == "rfc3339", F.try_to_timestamp(text))
        .when(kind == "unix", F.timestamp_seconds(text.try_cast("bigint")))
        .when(kind == "unix_ms", F.timestamp_millis(text.try_cast("bigint")))
        .when(kind == "date_only", F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    )


def words(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens, joined by spaces; none if there are fewer."""
    runs = lambda t: F.when(F.size(t) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " ")))).otherwise(F.array().cast("array<string>"))
    return once(tokens, runs)


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -]?[0-9]{3}[ -]?[0-9]{4}"
IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
KEY = r"AKIA[0-9A-Z]{16}"


def has_personal_data(text: Column) -> Column:
    return text.rlike(EMAIL) | text.rlike(PHONE) | text.rlike(IPV4) | text.rlike(KEY)


def scrubbed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, EMAIL, "[EMAIL]"), KEY, "[KEY]"), IPV4, "[IP]"), PHONE, "[PHONE]")
