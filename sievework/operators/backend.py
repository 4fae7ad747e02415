"""The remote guard: its policies, its answers, and merging them into local results."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.detect import finding

FLAG_SCORE = 0.8
#: validators of the input and the output guard with what happens when they fail, in order
INPUT_GUARD = (("DetectPII", "fix"), ("ToxicLanguage", "exception"), ("DetectJailbreak", "exception"), ("SecretsPresent", "fix"), ("UnusualPrompt", "noop"))
OUTPUT_GUARD = (("GroundedAIHallucination", "noop"), ("BiasCheck", "noop"), ("ToxicLanguage", "exception"), ("DetectPII", "fix"))
RESULT = "passed boolean, validated string, error string, flagged array<string>"


class Scorer(Protocol):
    """A model behind one validator. Loaded once per worker, called with batches."""

    def __call__(self, texts: Sequence[str]) -> list[tuple[bool, str | None]]:
        """(passed, rewritten text or None) of each text."""


def flag(text: Column) -> Column:
    """The finding that stands for a text the remote guard refused."""
    return finding("BACKEND_FLAG", F.lit("[backend validation failed]"), F.lit(0), F.length(text), 0.9, "high", "backend")


def merged(df: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """``df`` with ``backend_used`` and ``backend_failed``; what is missing or unavailable counts as passed."""
    v = verdicts.select(F.col(key), F.coalesce("available", F.lit(False)).alias("backend_used"), (F.coalesce("available", F.lit(False)) & ~F.coalesce("passed", F.lit(True))).alias("backend_failed"))
    out = df.drop("backend_used", "backend_failed").join(v, key, "left")
    return out.fillna(False, ["backend_used", "backend_failed"])


def applied(text: Column, outcomes: Sequence[tuple[str, str, Column, Column]]) -> Column:
    """``struct<passed, validated, error, flagged>``: policies of (name, policy, passed, rewritten) in order.

    fix takes the rewritten text; exception fails the call; noop only flags.
    """
    stops = [F.when(~ok, F.concat(F.lit(name), F.lit(" failed"))) for name, policy, ok, _ in outcomes if policy == "exception"]
    error = F.coalesce(*stops) if stops else F.lit(None).cast("string")
    value = text
    for _, policy, ok, new in outcomes:
        if policy == "fix":
            value = F.when(~ok, new).otherwise(value)
    flagged = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, _, ok, _ in outcomes]), lambda x: x.isNotNull())
    passed = error.isNull()
    return F.struct(passed.alias("passed"), F.when(passed, value).alias("validated"), error.alias("error"), flagged.alias("flagged"))


def guarded(df: DataFrame, key: str, text: str, scorers: Sequence[tuple[str, str, Callable[[], Scorer]]], attempts: int = 3, wait: float = 0.5) -> DataFrame:
    """(key, passed, validated, error, flagged) by models: (name, policy, factory) in order.

    Each worker makes its models once. A failing call is tried ``attempts`` times with doubled waits; a
    batch that can't be scored passes. A null text counts as empty.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = [(name, policy, make()) for name, policy, make in scorers]
        for b in batches:
            texts = ["" if t is None else t for t in b[text]]
            current, errors, flags = list(texts), [None] * len(texts), [[] for _ in texts]
            for name, policy, model in models:
                answers = _retried(model, current, attempts, wait)
                for i, (ok, new) in enumerate(answers):
                    if ok:
                        continue
                    flags[i].append(name)
                    if policy == "exception" and errors[i] is None:
                        errors[i] = f"{name} failed"
                    elif policy == "fix" and new is not None:
                        current[i] = new
            yield pd.DataFrame({key: b[key], "passed": [e is None for e in errors], "validated": [c if e is None else None for c, e in zip(current, errors, strict=True)], "error": errors, "flagged": flags})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, {RESULT}")


def _retried(model: Scorer, texts: list[str], attempts: int, wait: float) -> list[tuple[bool, str | None]]:
    for k in range(attempts):
        try:
            return model(texts)
        except ValueError:  # an answer to a bad request: asking again doesn't help
            break
        except Exception:  # noqa: BLE001
            if k + 1 < attempts:
                time.sleep(wait * 2**k)
    return [(True, None)] * len(texts)


ANSWER = "callId string, call_id string, rawLlmOutput string, raw_llm_output string, validatedOutput string, validated_output string, validationPassed boolean, validation_passed boolean, error string"


def parsed(answer: Column) -> Column:
    """A JSON answer in either spelling of its names as ``struct<call_id, raw, validated, passed, error>``."""
    j = F.from_json(answer, ANSWER)
    full = lambda c: F.when(c != "", c)
    return F.struct(
        F.coalesce(full(j["callId"]), full(j["call_id"]), F.lit("")).alias("call_id"), F.coalesce(j["rawLlmOutput"], j["raw_llm_output"]).alias("raw"), F.coalesce(j["validatedOutput"], j["validated_output"]).alias("validated"),
        F.coalesce(j["validationPassed"], j["validation_passed"], F.lit(False)).alias("passed"), full(j["error"]).alias("error"),
    )


VALIDATIONS = "array<struct<validator_name:string,passed:boolean,error_message:string,metadata:map<string,double>>>"


def extracted(answer: Column) -> Column:
    """Validations of a parsed answer: always one, called backend."""
    one = F.struct(F.lit("backend").alias("validator_name"), (answer["passed"] & answer["error"].isNull()).alias("passed"), answer["error"].alias("error_message"), F.lit(None).cast("map<string,double>").alias("metadata"))
    return F.array(one).cast(VALIDATIONS)


def hallucination_score(validations: Column) -> Column:
    """Score a hallucination validator states, else 0.1 or 0.8 by whether it passed, else 0."""
    mine = F.filter(validations, lambda v: F.contains(F.lower(v["validator_name"]), F.lit("hallucination")))
    said = F.filter(F.transform(mine, lambda v: F.coalesce(v["metadata"]["hallucination_score"], v["metadata"]["score"])), lambda s: s.isNotNull())
    first = F.get(mine, F.lit(0))
    return F.coalesce(F.get(said, F.lit(0)), F.when(first.isNotNull(), F.when(first["passed"], F.lit(0.1)).otherwise(F.lit(0.8))), F.lit(0.0))
