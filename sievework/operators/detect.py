"""Detectors: texts in, arrays of findings out, as column expressions.

Every detector is a function from the text column (and its lower-case twin) to
``array<struct<type, match, position, length, confidence, severity, validator>>``. Nothing shuffles and
nothing leaves the JVM. A null text has no findings. Positions and lengths count code points.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.dialect import java, loose
from sievework.functions.spans import RAW, spans
from sievework.operators import rules as R

FINDING = "struct<type:string,match:string,position:int,length:int,confidence:double,severity:string,validator:string>"
FINDINGS = f"array<{FINDING}>"
NONE = f"CAST(array() AS {FINDINGS})"


def none() -> Column:
    return F.expr(NONE)


def finding(type_: Column | str, match: Column, position: Column, length: Column, confidence: Column | float, severity: Column | str, validator: str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(type_).alias("type"), match.alias("match"), position.cast("int").alias("position"), length.cast("int").alias("length"), lit(confidence).cast("double").alias("confidence"), lit(severity).alias("severity"), F.lit(validator).alias("validator")
    )


# ------------------------------------------------------------------------------------------------ post checks
def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _octets(c: Column) -> Column:
    return F.forall(F.split(c, r"\."), lambda o: o.cast("int") <= 255)


def _luhn(c: Column) -> Column:
    return F.call_function("luhn_check", _digits(c))


def _phone(c: Column) -> Column:
    return F.length(_digits(c)).between(10, 11)


CHECKS = {"phone": _phone, "luhn": _luhn, "octets": _octets}


# ---------------------------------------------------------------------------------------------- display masks
def mask_personal(value: Column, kind: str) -> Column:
    """What a log may show of a personal value of ``kind``."""
    if kind == "SSN":
        return F.concat(F.left(value, F.lit(3)), F.lit("-**-"), F.right(value, F.lit(4)))
    if kind == "EMAIL":
        return F.concat(F.left(F.substring_index(value, "@", 1), F.lit(2)), F.lit("***@"), F.split_part(value, F.lit("@"), F.lit(2)))
    if kind == "CREDIT_CARD":
        return F.concat(F.left(_digits(value), F.lit(4)), F.lit("-****-****-"), F.right(_digits(value), F.lit(4)))
    if kind in ("PHONE", "PHONE_INTL"):
        return F.concat(F.left(value, F.lit(3)), F.lit("****"), F.right(value, F.lit(3)))
    return F.when(F.length(value) > 6, F.concat(F.left(value, F.lit(3)), F.lit("***"), F.right(value, F.lit(2)))).otherwise(F.lit("***"))


def mask_term(term: Column) -> Column:
    """What a log may show of a toxic term."""
    stars = F.repeat(F.lit("*"), F.greatest(F.length(term) - 4, F.lit(1)))
    return F.when(F.length(term) <= 3, F.lit("***")).otherwise(F.concat(F.left(term, F.lit(2)), stars, F.right(term, F.lit(2))))


def shortened(value: Column, most: int = 60) -> Column:
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most)), F.lit("..."))).otherwise(value)


# --------------------------------------------------------------------------------------------------- detectors
RUN_OF_20, RUN_OF_40 = (f"[A-Za-z0-9+/]{{{n}}}" for n in (20, 40))


def _test(rule: R.Rule, text: Column, lower: Column) -> Column | None:
    groups = [reduce(lambda a, b: a | b, [F.contains(c, F.lit(h)) for h in g]) for c, g in ((text, rule.exact), (lower, rule.hints), (lower, rule.also)) if g]
    return reduce(lambda a, b: a & b, groups) if groups else None


def long_run(text: Column) -> Column:
    """Whether twenty characters of base64 stand in a row; several rules need that."""
    return F.regexp_like(text, F.lit(RUN_OF_20))


def by_rules(text: Column, lower: Column, validator: str, show, run: Column | None = None) -> Column:
    """Findings of all rules of ``validator``, in the order of the rules. ``run``: ``long_run``, if at hand."""

    def one(rule: R.Rule) -> Column:
        long = rule.type in ("AWS_SECRET_KEY", "AZURE_KEY")
        quick = RUN_OF_40 if long else loose(rule.pattern, rule.ignore_case)
        test = _test(rule, text, lower)
        if long and run is not None:
            test = run if test is None else test & run
        hits = spans(text, java(rule.pattern, rule.ignore_case), test, quick)
        if rule.check:
            hits = F.filter(hits, lambda h: CHECKS[rule.check](h["text"]))
        return F.transform(hits, lambda h: finding(rule.type, show(h["text"], rule.type), h["position"], h["length"], rule.confidence, rule.severity, validator))

    return F.flatten(F.array(*[one(r) for r in R.RULES[validator]]))


#: seven digits close to each other, which all rules of personal data need but those of e-mail and IP addresses
SEVEN_DIGITS, DOTTED = "[0-9](?:[^0-9A-Za-z]{0,3}[0-9]){6}", r"[0-9]\.[0-9]{1,3}\.[0-9]"


def pii(text: Column, lower: Column) -> Column:
    some = F.contains(text, F.lit("@")) | F.regexp_like(text, F.lit(SEVEN_DIGITS)) | F.regexp_like(text, F.lit(DOTTED))
    return F.when(some, by_rules(text, lower, "pii", mask_personal)).otherwise(none())


def secrets(text: Column, lower: Column, run: Column | None = None) -> Column:
    show = lambda v, kind: F.when(F.length(v) > 8, F.concat(F.left(v, F.lit(4)), F.lit("***"), F.right(v, F.lit(2)))).otherwise(F.lit("***"))
    return by_rules(text, lower, "secrets", show, run)


def injection(text: Column, lower: Column) -> Column:
    return by_rules(text, lower, "injection", lambda v, kind: shortened(v))


def decoded(candidate: Column) -> Column:
    """A candidate as its bytes' text: padding is optional, a lone last character is dropped, bad bytes become U+FFFD."""
    bare = F.rtrim(candidate, F.lit("="))
    bare = F.when(F.length(bare) % 4 == 1, F.left(bare, F.length(bare) - 1)).otherwise(bare)
    return F.make_valid_utf8(F.unbase64(bare).cast("string"))


def payloads(text: Column, run: Column | None = None) -> Column:
    """Base64 runs that decode to readable text with a suspicious word."""
    hits = spans(text, java(R.BASE64), long_run(text) if run is None else run)
    # '=' is no word character, so the boundary keeps it out of the match
    with_text = F.transform(hits, lambda h: F.struct(h["position"].alias("position"), h["length"].alias("length"), decoded(h["text"]).alias("d")))
    readable = lambda d: F.length(F.regexp_replace(d, "[^ -~]", "")) / F.length(d) >= 0.7
    words = [w for w in R.BASE64_KEYWORDS if w == w.lower()]  # an upper-case word never equals lower-case text
    bad = lambda d: reduce(lambda a, b: a | b, [F.contains(F.lower(d), F.lit(w)) for w in words])
    kept = F.filter(with_text, lambda h: (F.length(h["d"]) > 0) & readable(h["d"]) & bad(h["d"]))
    show = lambda d: F.concat(F.lit('[base64 → "'), shortened(d, 40), F.lit('"]'))
    return F.transform(kept, lambda h: finding("BASE64_INJECTION", show(h["d"]), h["position"], h["length"], 0.90, "critical", "jailbreak"))


def zero_width(text: Column) -> Column:
    """The first invisible character only."""
    at = F.length(F.split(text, R.ZERO_WIDTH, 2)[0])  # in code points, which the place of a match isn't
    one = finding("UNICODE_OBFUSCATION", F.concat(F.lit("[zero-width characters detected at position "), at.cast("string"), F.lit("]")), at, F.lit(1), 0.70, "medium", "jailbreak")
    return F.when(F.regexp_like(text, F.lit(R.ZERO_WIDTH)), F.array(one)).otherwise(none())


def mixed_scripts(text: Column) -> Column:
    """One finding over the whole text if Cyrillic and Latin letters meet in it."""
    shown = F.lit("[Cyrillic + Latin script mixing detected — possible homoglyph obfuscation]")
    one = finding("HOMOGLYPH_ATTACK", shown, F.lit(0), F.length(text), 0.60, "medium", "jailbreak")
    return F.when(F.regexp_like(text, F.lit(R.CYRILLIC)) & F.regexp_like(text, F.lit("[a-zA-Z]")), F.array(one)).otherwise(none())


def jailbreak(text: Column, lower: Column, run: Column | None = None) -> Column:
    rest = [payloads(text, run), zero_width(text), mixed_scripts(text)]
    return F.coalesce(F.concat(by_rules(text, lower, "jailbreak", lambda v, kind: shortened(v)), *rest), none())


def _escaped(term: str) -> str:
    return "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in term)


def blocklist(terms: Sequence[str]) -> list[str]:
    """A custom list as it is used: lower case, trimmed, without empty entries."""
    return [t for t in (x.lower().strip() for x in terms) if t]


def toxicity(text: Column, lower: Column, custom: Sequence[str] = ()) -> Column:
    """Whole-word hits of the phrases, sought in lower-case text.

    Phrases that aren't contained in the text are dropped before any pattern is compiled, so the patterns,
    which come from a literal array, are compiled for the few texts that hold their phrase.
    """
    phrases = [(cat, sev, p, R.TOXIC_CONFIDENCE) for cat, (sev, ps) in R.TOXIC.items() for p in ps] + [("CUSTOM_BLOCKED", "high", t, R.BLOCKED_CONFIDENCE) for t in blocklist(custom)]
    table = F.array(*[F.struct(F.lit(c).alias("type"), F.lit(s).alias("severity"), F.lit(p).alias("phrase"), F.lit(java(f"\\b{_escaped(p)}\\b")).alias("pattern"), F.lit(k).alias("confidence")) for c, s, p, k in phrases])
    held = F.filter(table, lambda p: F.contains(lower, p["phrase"]))
    found = F.transform(held, lambda p: F.transform(spans(lower, p["pattern"]), lambda h: finding(p["type"], mask_term(p["phrase"]), h["position"], F.length(p["phrase"]), p["confidence"], p["severity"], "toxicity")))
    return F.coalesce(F.flatten(found), none())


#: detectors that can use ``long_run``
RUN_USERS = ("secrets", "jailbreak")
DETECTORS = {"pii": pii, "secrets": secrets, "injection": injection, "jailbreak": jailbreak, "toxicity": toxicity}
