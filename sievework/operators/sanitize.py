"""Overlap resolution, replacement of spans, clean-up of white space, and the log of changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.dialect import END, SPACE
from sievework.functions.spans import SENTINEL
from sievework.operators import registry
from sievework.operators import rules as R
from sievework.operators.detect import FINDINGS, none

#: the white space of SPACE as characters
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def _replacement(finding: Column) -> Column:
    """What a finding is replaced by; null where nothing handles its type."""
    own = registry.REPLACEMENTS
    fixed = {**R.REPLACEMENTS, **{k: v for k, v in own.items() if isinstance(v, str)}}
    out = F.element_at(F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv]), finding["type"])
    for kind, make in own.items():
        if not isinstance(make, str):
            out = F.when(finding["type"] == kind, make(finding)).otherwise(out)
    return out


def deduplicated(findings: Column) -> Column:
    """Findings without overlaps, by position.

    They are walked by position, longer first. One that begins before the last kept one ends takes its place
    if its confidence is strictly higher, else it is dropped. What the displaced one covered besides is not
    looked at again. The walk carries state, so it is a fold and not a window.
    """
    keyed = F.transform(findings, lambda f, i: F.struct(f["position"].alias("p"), (-f["length"]).alias("l"), i.alias("i"), f.alias("f")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["f"])

    def step(kept: Column, f: Column) -> Column:
        last = F.element_at(kept, -1)
        clear = (F.size(kept) == 0) | (f["position"] >= last["position"] + last["length"])
        better = f["confidence"] > last["confidence"]
        return F.when(clear, F.array_append(kept, f)).when(better, F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), f)).otherwise(kept)

    return F.when(F.size(findings) > 0, F.aggregate(ordered, none(), step)).otherwise(findings.cast(FINDINGS))


def changes(text: Column, kept: Column) -> Column:
    """``array<struct<finding, replacement, position, original_text>>``, last position first."""
    handled = F.filter(kept, lambda f: _replacement(f).isNotNull())
    log = F.transform(handled, lambda f: F.struct(f.alias("finding"), _replacement(f).alias("replacement"), f["position"].alias("position"), F.substring(text, f["position"] + 1, f["length"]).alias("original_text")))
    return F.reverse(log)


def replaced(text: Column, change_log: Column) -> Column:
    """``text`` with every change applied, put together in one pass from left to right."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        between = F.substring(text, acc["at"] + 1, c["position"] - acc["at"])
        return F.struct(F.array_append(F.array_append(acc["out"], between), c["replacement"]).alias("out"), (c["position"] + c["finding"]["length"]).alias("at"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(change_log) > 0, F.aggregate(F.reverse(change_log), start, step, rest)).otherwise(text)


def cleaned(text: Column) -> Column:
    """White space left over by removals brought in order.

    Runs of blanks become one; three or more line ends become two; a run at the start or end of a line
    becomes a line end if it holds one, else one blank; the whole is trimmed.
    """
    trim = lambda c: F.btrim(c, F.lit(BLANKS))
    t = F.regexp_replace(text, "[ \\t]{2,}", " ")
    t = F.regexp_replace(t, f"\\n[{SPACE}]*\\n[{SPACE}]*\\n", "\n\n")
    # looking ahead for a blank first fails at once on all other characters
    run = f"(?=[{SPACE}])(?:(?<![^{END}])[{SPACE}]+|[{SPACE}]+(?![^{END}]))"
    parts = F.split(F.regexp_replace(F.translate(t, SENTINEL, "�"), run, f"{SENTINEL}$0{SENTINEL}"), SENTINEL, -1)
    one = lambda p, i: F.when(i % 2 == 0, p).when(F.contains(p, F.lit("\n")), F.lit("\n")).otherwise(F.lit(" "))
    t = F.when(F.regexp_like(t, F.lit(run)), F.array_join(F.transform(parts, one), "")).otherwise(t)
    # all steps but the last need two blanks in a row
    return F.when(F.regexp_like(text, F.lit(f"[{SPACE}]{{2}}")), trim(t)).otherwise(trim(text))


def sanitized(text: Column, findings: Column, change_log: Column) -> Column:
    """The text after replacement and clean-up; untouched where nothing was found."""
    return F.when(F.size(findings) > 0, cleaned(replaced(text, change_log))).otherwise(text)


def can_sanitize(findings: Column, kept: Column, clean: Column) -> Column:
    """False if a kept finding can't be sanitized, or if nothing of the text is left."""
    stuck = F.exists(kept, lambda f: f["type"].isin(*R.NEVER_SANITIZED))
    blank = F.length(F.regexp_replace(clean, f"[{SPACE}]", "")) == 0
    return F.when(F.size(findings) > 0, ~(stuck | blank)).otherwise(F.lit(True))
