"""Reward functions of a response, each a column in [0, 1]; an empty response gets 0 unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import words


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != "")


def distinct_ratio(c: Column) -> Column:
    t = tokens(c)
    return F.when(F.size(t) > 0, F.size(F.array_distinct(t)) / F.size(t)).otherwise(0.0)


def _empty(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def coherence_score(c: Column) -> Column:
    return F.when(_empty(c), 0.0).when(distinct_ratio(c) < 0.3, 0.4).otherwise(0.9)


def coverage_score(c: Column) -> Column:
    return F.when(_empty(c), 0.0).when(distinct_ratio(c) < 0.3, 0.3).when(F.size(tokens(c)) < 3, 0.4).otherwise(0.9)


def summary_quality(c: Column) -> Column:
    return (coherence_score(c) + coverage_score(c)) / 2


def uniqueness_check(c: Column) -> Column:
    r = distinct_ratio(c)
    return F.when(_empty(c), 0.0).when(r > 0.7, 1.0).when(r > 0.5, 0.7).when(r > 0.3, 0.4).otherwise(0.1)


def recall_improvement(c: Column) -> Column:
    n = F.size(tokens(c))
    return F.when(_empty(c), 0.0).when(n > 3, F.least(F.lit(1.0), 0.5 + 0.05 * n)).otherwise(0.3)


def insight_count(c: Column) -> Column:
    found = F.regexp_count(c, F.lit(r"(^|\n)\s*[-*•]\s")) + F.regexp_count(c, F.lit(r"[.!?](\s|$)"))
    return F.when(_empty(c), 0.0).when(found >= 1, 0.9).otherwise(0.2)


def format_valid(c: Column) -> Column:
    opens = F.trim(c).startswith("{") | F.trim(c).startswith("[")
    return F.when(_empty(c), 0.0).when(opens, F.when(F.try_parse_json(c).isNotNull(), 1.0).otherwise(0.0)).otherwise(1.0)


def json_valid(c: Column) -> Column:
    return F.when(F.try_parse_json(c).isNotNull(), 1.0).otherwise(0.0)


def schema_match(c: Column, required: list[str]) -> Column:
    """Share of required keys that a JSON object has."""
    keys = F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    return F.when(_empty(c), 0.0).otherwise(F.size(F.array_intersect(keys, F.array(*map(F.lit, required)))) / len(required) if required else F.lit(1.0))


def latency_reward(ms: Column, budget: float) -> Column:
    return 1 / (1 + F.exp(5 * (ms / budget - 1)))


def concision_ratio(c: Column, reference: Column) -> Column:
    return F.when(_empty(c), 0.0).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.length(reference) / F.length(c))))


def _bigrams(c: Column) -> Column:
    t = words(c)
    return F.when(F.size(t) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.array_join(F.slice(t, i, 2), " ")))).otherwise(F.array().cast("array<string>"))


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two sets; 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * both / (F.size(a) + F.size(b)))


def factuality_score(c: Column, reference: Column) -> Column:
    return F.when(_empty(c), 0.0).otherwise(set_f1(_bigrams(c), _bigrams(reference)))


def citation_precision(found: Column, known: Column) -> Column:
    return F.when(F.size(found) > 0, F.size(F.array_intersect(found, known)) / F.size(found)).otherwise(0.0)


def false_positive_penalty(predicted: Column, true: Column) -> Column:
    return F.when(F.size(predicted) > 0, 1 - F.size(F.array_except(predicted, true)) / F.size(predicted)).otherwise(1.0)


def classification_accuracy(c: Column, target: Column) -> Column:
    label = F.coalesce(*(F.get_json_object(c, f"$.{k}") for k in ("type", "classification", "label")))
    return F.when(_empty(c), 0.0).when(target.isNull(), json_valid(c)).otherwise(F.when(F.lower(label) == F.lower(target), 1.0).otherwise(0.0))


def score_calibration(values: Column) -> Column:
    good = F.size(F.filter(values, lambda v: (v >= 0) & (v <= 1)))
    return F.when(F.size(values) > 0, good / F.size(values)).otherwise(0.0)


#: Rewards of the response alone, by name; `register` offers them to SQL.
OF_RESPONSE = {f.__name__: f for f in (coherence_score, coverage_score, summary_quality, uniqueness_check, recall_improvement, insight_count, format_valid, json_valid)}
