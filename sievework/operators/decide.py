"""The decision on a text and its reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.operators import rules as R

THRESHOLD = 0.3
PASSED = "Prompt passed all security checks."


def action(findings: Column, score: Column, threshold: float = THRESHOLD) -> Column:
    """ALLOW without findings and below the threshold, else SANITIZE; nothing is ever blocked."""
    return F.when((F.size(findings) == 0) & (score < threshold), F.lit("ALLOW")).otherwise(F.lit("SANITIZE"))


def label(kind: Column, table: dict[str, str] = R.REASON_LABELS) -> Column:
    """A type in words; unknown ones in lower case with blanks."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), kind)
    return F.coalesce(known, F.replace(F.lower(kind), F.lit("_"), F.lit(" ")))


def reason(act: Column, change_log: Column, critical: Column) -> Column:
    """How many changes of which type, types in the order of the log."""
    kinds = F.array_distinct(F.transform(change_log, lambda c: c["finding"]["type"]))

    def part(kind: Column) -> Column:
        n = F.size(F.filter(change_log, lambda c: c["finding"]["type"] == kind))
        return F.concat(n.cast("string"), F.lit(" "), label(kind), F.when(n > 1, F.lit("s")).otherwise(F.lit("")), F.lit(" masked"))

    head = F.when(critical, F.lit("⚠️ Critical risk detected — prompt masked for safety")).otherwise(F.lit("Prompt modified for safety"))
    said = F.concat(head, F.lit(": "), F.array_join(F.transform(kinds, part), ", "), F.lit("."))
    return F.when(act == "ALLOW", F.lit(PASSED)).otherwise(said)
