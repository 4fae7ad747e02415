"""How well a response is grounded, from the remote guard's answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCES = "array<struct<text:string,confidence:double,level:string,reasons:array<string>>>"
UNAVAILABLE = "[Hallucination analysis unavailable — Guardrails AI backend not connected]"


def level(score: Column) -> Column:
    """grounded from 0.7, uncertain from 0.4, else hallucinated."""
    return F.when(score >= 0.7, F.lit("grounded")).when(score >= 0.4, F.lit("uncertain")).otherwise(F.lit("hallucinated"))


def _sentence(text: Column, confidence: Column | float, level_: Column | str, reason: Column | str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(text).alias("text"), lit(confidence).cast("double").alias("confidence"), lit(level_).alias("level"), F.array(lit(reason)).alias("reasons"))


def grounding(response: Column, available: Column, passed: Column, score: Column, validations: Column) -> Column:
    """``struct<sentences, overall_score, overall_level, counts, has_hallucination>`` of a response.

    ``score``: of hallucination, high is bad. A hallucination is detected if the guard or a validator of
    that name failed. A failed validator that is neither about hallucination nor bias adds a sentence.
    Without an available guard everything counts as grounded.
    """
    s = F.lit(1.0) - score
    whole = level(s)
    preview = F.when(F.length(response) > 200, F.concat(F.left(response, F.lit(200)), F.lit("..."))).otherwise(response)
    of = lambda v, w: F.contains(F.lower(v["validator_name"]), F.lit(w))
    bad = ~passed | F.exists(validations, lambda v: of(v, "hallucination") & ~v["passed"])
    bias = F.exists(validations, lambda v: of(v, "bias") & ~v["passed"])
    said = F.format_string("GroundedAIHallucination: score %.2f (ML model)", score)
    main = F.when(bad, _sentence(preview, s, whole, said)).otherwise(_sentence(preview, s, "grounded", "GroundedAIHallucination: response appears well-grounded (ML model)"))
    biased = _sentence(F.lit("[Guardrails AI: BiasCheck detected potential bias in response]"), 0.4, "uncertain", "Bias detected by ML classifier (Guardrails AI BiasCheck)")
    own = lambda v: F.lower(v["validator_name"]).rlike("hallucination|bias")
    failed = F.filter(validations, lambda v: ~v["passed"] & ~own(v))
    others = F.transform(
        failed,
        lambda v: _sentence(F.concat(F.lit("["), v["validator_name"], F.lit(": "), F.coalesce(v["error_message"], F.lit("validation failed")), F.lit("]")), 0.3, "hallucinated", F.concat(v["validator_name"], F.lit(" flagged this response"))),
    )
    empty = F.array().cast(SENTENCES)
    sentences = F.concat(F.array(main), F.when(bias, F.array(biased)).otherwise(empty), others)
    nothing = F.array(_sentence(F.lit(UNAVAILABLE), 1.0, "grounded", "Backend unavailable — no analysis performed"))
    on = F.coalesce(available, F.lit(False))
    shown = F.when(on, sentences).otherwise(nothing)
    n = lambda name: F.size(F.filter(shown, lambda x: x["level"] == name)).alias(name)
    return F.struct(
        shown.alias("sentences"), F.when(on, s).otherwise(F.lit(1.0)).alias("overall_score"), F.when(on, whole).otherwise(F.lit("grounded")).alias("overall_level"),
        F.struct(n("grounded"), n("uncertain"), n("hallucinated")).alias("counts"), F.when(on, bad | bias | ~passed).otherwise(F.lit(False)).alias("has_hallucination"),
    )


def analysed(action: Column, response: Column) -> Column:
    """Whether a response is analysed at all: always after ALLOW, only a non-empty one after SANITIZE."""
    return (action == "ALLOW") | (F.length(F.coalesce(response, F.lit(""))) > 0)


def assembled(chunks: Column) -> Column:
    """A response of ``array<struct<seq, chunk>>``, chunks in the order of their numbers."""
    return F.array_join(F.transform(F.array_sort(chunks), lambda x: x["chunk"]), "")
