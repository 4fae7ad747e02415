"""Validators and replacements of a user's own, beside the built-in ones.

A validator is a pair of column expressions: one that finds, one that scores. It is planned with the others
in the order of registration, can be switched off by its name, and has a weight in the risk. A replacement
says what a type of finding becomes: a fixed text, or an expression of the finding.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column

from sievework.operators import rules as R
from sievework.operators.detect import FINDINGS, none
from sievework.operators.score import mean_score

Replacement = str | Callable[[Column], Column]


@dataclass(frozen=True)
class Validator:
    """``detect(text, lower)`` gives the findings of a text that is never null, ``score(findings)`` a number from 0 to 1."""

    name: str
    detect: Callable[[Column, Column], Column]
    score: Callable[[Column], Column] = mean_score
    weight: float = R.OTHER_WEIGHT
    replacements: Mapping[str, Replacement] = field(default_factory=dict)


VALIDATORS: dict[str, Validator] = {}
REPLACEMENTS: dict[str, Replacement] = {}
_CHANGES = [0]


def register(validator: Validator) -> None:
    """Add a validator, or put it in the place of the one of its name. Built-in names are taken."""
    if validator.name in R.VALIDATORS:
        raise ValueError(f"{validator.name} is built in")
    VALIDATORS[validator.name] = validator
    REPLACEMENTS.update(validator.replacements)
    _CHANGES[0] += 1


def register_replacement(kind: str, replacement: Replacement) -> None:
    """What findings of type ``kind`` are replaced by, also for built-in types."""
    REPLACEMENTS[kind] = replacement
    _CHANGES[0] += 1


def unregister(name: str) -> None:
    """Take a validator out, with its replacements; an unknown name is passed over."""
    for kind in (VALIDATORS.pop(name).replacements if name in VALIDATORS else ()):
        REPLACEMENTS.pop(kind, None)
    _CHANGES[0] += 1


def clear() -> None:
    VALIDATORS.clear(), REPLACEMENTS.clear()
    _CHANGES[0] += 1


def version() -> int:
    """Changes whenever something is registered; expressions built before are not used after."""
    return _CHANGES[0]


def found_by(name: str, text: Column, lower: Column) -> Column:
    """Findings of a registered validator. One that can't be planned finds nothing and is logged; the others go on."""
    try:
        return VALIDATORS[name].detect(text, lower).cast(FINDINGS)
    except Exception:  # noqa: BLE001
        logging.getLogger("sievework").warning("validator %s failed", name, exc_info=True)
        return none()
