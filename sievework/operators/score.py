"""Scores of the validators, the weighted risk, and what dominates it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.operators import rules as R


def severity_rank(severity: Column) -> Column:
    """low 0 to critical 3; null for anything else."""
    at = F.array_position(F.array(*[F.lit(s) for s in R.SEVERITIES]), severity).cast("int")
    return F.when(at > 0, at - 1)


def highest_severity(findings: Column) -> Column:
    """The highest severity in an array of findings; low if it is empty."""
    top = F.coalesce(F.array_max(F.transform(findings, lambda f: severity_rank(f["severity"]))), F.lit(0))
    return F.element_at(F.array(*[F.lit(s) for s in R.SEVERITIES]), top + 1)


def _weight(severity: Column, table: Mapping[str, float]) -> Column:
    out = F.when(severity == R.SEVERITIES[0], F.lit(table[R.SEVERITIES[0]]))
    for s in R.SEVERITIES[1:]:
        out = out.when(severity == s, F.lit(table[s]))
    return out.otherwise(F.lit(0.5))


def _kinds(findings: Column) -> Column:
    return F.size(F.array_distinct(F.transform(findings, lambda f: f["type"])))


def _max_confidence(findings: Column) -> Column:
    return F.array_max(F.transform(findings, lambda f: f["confidence"]))


def mean_score(f: Column) -> Column:
    """Of pii and secrets: mean of severity weight times confidence, raised by the number of findings."""
    total = F.aggregate(f, F.lit(0.0), lambda acc, x: acc + _weight(x["severity"], R.SEVERITY_WEIGHT) * x["confidence"])
    return F.when(F.size(f) > 0, F.least(total / F.size(f) + F.least(F.size(f) * 0.1, F.lit(0.3)), F.lit(1.0))).otherwise(F.lit(0.0))


def injection_score(f: Column) -> Column:
    """Best confidence, raised by the number of techniques and of findings."""
    raised = _max_confidence(f) + F.least((_kinds(f) - 1) * 0.15, F.lit(0.3)) + F.least((F.size(f) - 1) * 0.05, F.lit(0.2))
    return F.when(F.size(f) > 0, F.least(raised, F.lit(1.0))).otherwise(F.lit(0.0))


def jailbreak_score(f: Column) -> Column:
    """Best confidence, with a floor for named jailbreaks and payloads, raised by the number of techniques."""
    has = lambda t: F.exists(f, lambda x: x["type"] == t)
    base = F.greatest(_max_confidence(f), F.when(has("NAMED_JAILBREAK"), F.lit(0.95)).otherwise(F.lit(0.0)), F.when(has("BASE64_INJECTION"), F.lit(0.90)).otherwise(F.lit(0.0)))
    return F.when(F.size(f) > 0, F.least(base + F.least((_kinds(f) - 1) * 0.1, F.lit(0.2)), F.lit(1.0))).otherwise(F.lit(0.0))


def toxicity_score(f: Column) -> Column:
    """Worst severity weight times confidence, raised by the number of findings."""
    worst = F.array_max(F.transform(f, lambda x: _weight(x["severity"], R.TOXIC_WEIGHT) * x["confidence"]))
    return F.when(F.size(f) > 0, F.least(worst + F.least((F.size(f) - 1) * 0.1, F.lit(0.2)), F.lit(1.0))).otherwise(F.lit(0.0))


SCORES = {"pii": mean_score, "secrets": mean_score, "injection": injection_score, "jailbreak": jailbreak_score, "toxicity": toxicity_score}


def weight_of(validator: str, weights: Mapping[str, float] | None = None) -> float:
    """Weight of a validator, clamped to 0..1; unknown ones have OTHER_WEIGHT."""
    w = {**R.WEIGHTS, **(weights or {})}.get(validator, R.OTHER_WEIGHT)
    return min(max(w, 0.0), 1.0)


def risk(scores: Mapping[str, Column], findings: Column, weights: Mapping[str, float] | None = None, present: Mapping[str, Column] | None = None) -> Column:
    """``struct<final_score, dominant, breakdown, critical>`` of the scores of the enabled validators, in order.

    The denominator counts every enabled validator, whether or not it fired. A critical finding makes the
    score 1. The first of equal weighted scores dominates. ``present``: conditions under which a validator
    counts at all, for those that don't run on every row.
    """
    on = {v: (present or {}).get(v, F.lit(True)) for v in scores}
    zero = F.lit(0.0)
    if not scores:
        return F.struct(zero.alias("final_score"), F.lit("none").alias("dominant"), F.create_map().cast("map<string,double>").alias("breakdown"), F.lit(False).alias("critical"))
    weighted = {v: s * F.lit(weight_of(v, weights)) for v, s in scores.items()}
    total = sum((F.when(on[v], w).otherwise(zero) for v, w in weighted.items()), zero)
    parts = sum((F.when(on[v], F.lit(weight_of(v, weights))).otherwise(zero) for v in weighted), zero)
    critical = F.coalesce(F.exists(findings, lambda f: f["severity"] == "critical"), F.lit(False))
    mean = F.when(parts > 0, F.least(F.greatest(total / parts, zero), F.lit(1.0))).otherwise(zero)
    # the first of the highest: later ones must be strictly greater
    best, name = F.lit(-1.0), F.lit("none")
    for v, w in weighted.items():
        wins = on[v] & (w > best)
        name, best = F.when(wins, F.lit(v)).otherwise(name), F.when(wins, w).otherwise(best)
    breakdown = F.map_filter(F.create_map(*[x for v, s in scores.items() for x in (F.lit(v), F.when(on[v], s))]), lambda k, s: s.isNotNull())
    return F.struct(F.when(critical, F.lit(1.0)).otherwise(mean).alias("final_score"), name.alias("dominant"), breakdown.alias("breakdown"), critical.alias("critical"))


def enabled(names: Sequence[str] | None, known: Sequence[str] = R.VALIDATORS) -> list[str]:
    """The validators that run, in the order of their registration; all if no list is given."""
    return [v for v in known if names is None or v in names]
