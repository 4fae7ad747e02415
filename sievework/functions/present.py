"""Values as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.operators import rules as R
from sievework.operators.decide import label

DOT = "•"
# Icons, tags and labels.
SEVERITY_ICON = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🟢"}
CATEGORY_ICON = {"pii": "👤", "secrets": "🔑", "injection": "💉", "jailbreak": "🔓", "toxicity": "☠️"}
CATEGORY_LABEL = {"pii": "Personal Information (PII)", "secrets": "Secrets & API Keys", "injection": "Prompt Injection", "jailbreak": "Jailbreak Attempt", "toxicity": "Toxic Content"}
LEVEL_ICON = {"grounded": "🟢", "uncertain": "🟡", "hallucinated": "🔴"}
LEVEL_LABEL = {"grounded": "Well-grounded", "uncertain": "Some uncertainty", "hallucinated": "Likely hallucinated"}
CATEGORY_TYPES = {
    "pii": ("ssn", "email", "phone", "phone_intl", "credit_card", "ip_address", "passport", "dob"),
    "secrets": ("aws_access_key", "aws_secret_key", "github_token", "gitlab_token", "jwt", "api_key", "connection_string", "private_key", "slack_token", "stripe_key", "azure_key", "npm_token", "password"),
    "injection": ("instruction_override", "role_hijack", "prompt_extraction", "delimiter_injection", "restriction_removal"),
    "jailbreak": ("named_jailbreak", "developer_mode", "dual_response", "encoding_evasion"),
    "toxicity": (),
}
CATEGORY_WORD = {"pii": "pii", "secrets": "secret", "injection": "injection", "jailbreak": "jailbreak", "toxicity": "toxic"}
PHRASE_TYPES = ("INSTRUCTION_OVERRIDE", "ROLE_HIJACK", "PROMPT_EXTRACTION", "DELIMITER_INJECTION", "RESTRICTION_REMOVAL", "NAMED_JAILBREAK", "DEVELOPER_MODE", "DUAL_RESPONSE", "ENCODING_EVASION")


def chosen(key: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(other))


def severity_icon(s: Column) -> Column:
    return chosen(s, SEVERITY_ICON, "⚪")


def severity_tag(s: Column) -> Column:
    return F.when(s.isin(*SEVERITY_ICON), F.upper(s)).otherwise(F.lit("UNKNOWN"))


def risk_label(score: Column) -> Column:
    return F.when(score < 0.3, F.lit("Low")).when(score < 0.7, F.lit("Medium")).otherwise(F.lit("High"))


def percent(score: Column) -> Column:
    """Per cent without decimals, halves upwards."""
    return F.concat(F.floor(score * 100 + 0.5).cast("string"), F.lit("%"))


def bar(score: Column, good_is_high: bool = False) -> Column:
    """Twenty cells, filled in proportion; coloured by risk, or by confidence."""
    n = F.least(F.greatest(F.floor(score * 20 + 0.5), F.lit(0)), F.lit(20)).cast("int")
    color = F.when(score >= 0.7, F.lit("🟩")).when(score >= 0.4, F.lit("🟨")).otherwise(F.lit("🟥")) if good_is_high else F.when(score >= 0.7, F.lit("🟥")).when(score >= 0.3, F.lit("🟨")).otherwise(F.lit("🟩"))
    return F.concat(F.repeat(color, n), F.repeat(F.lit("⬜"), 20 - n))


def risk_bar(score: Column) -> Column:
    return F.concat(F.lit("**Risk:** `"), percent(score), F.lit("` "), bar(score), F.lit(" *"), risk_label(score), F.lit("*"))


def confidence_bar(score: Column) -> Column:
    return F.concat(F.lit("`"), percent(score), F.lit("` "), bar(score, True))


def category(name: Column) -> Column:
    """Category of a validator's or a type's name, the first that fits."""
    v = F.lower(name)
    out = None
    for c, word in CATEGORY_WORD.items():
        fits = F.contains(v, F.lit(word))
        fits = fits | v.isin(*CATEGORY_TYPES[c]) if CATEGORY_TYPES[c] else fits
        out = F.when(fits, F.lit(c)) if out is None else out.when(fits, F.lit(c))
    return out.otherwise(F.lit("other"))


def short_label(kind: Column) -> Column:
    return label(kind, R.SHORT_LABELS)


def _dots(n: Column, most: int | None = None) -> Column:
    return F.repeat(F.lit(DOT), F.least(n, F.lit(most)) if most else n)


def masked(value: Column, kind: Column) -> Column:
    """Enough of a detected value to recognise it. The order of the cases matters."""
    t, n = F.upper(kind), F.length(value)
    digits = F.regexp_replace(value, "[^0-9]", "")
    left, right = lambda k: F.left(value, F.lit(k)), lambda k: F.right(value, F.lit(k))
    has = lambda w: F.contains(t, F.lit(w))
    at, proto, dot = F.locate("@", value), F.locate("://", value), F.locate(".", value)
    rest = F.when(n > 10, F.concat(left(4), _dots(n - 8, 10), right(4))).otherwise(F.concat(left(2), _dots(n - 2)))
    return (
        F.when(value.isNull() | (n < 4), F.lit(DOT * 4))
        .when(t == "SSN", F.concat(left(3), F.lit("-••-••••")))
        .when(t == "EMAIL", F.when(at > 3, F.concat(left(2), F.lit("••"), F.substring(value, at, n))).otherwise(F.concat(left(2), F.lit("••••"))))
        .when(t == "CREDIT_CARD", F.concat(F.lit("••••-••••-••••-"), F.right(digits, F.lit(4))))
        .when(has("PHONE"), F.concat(F.lit("(•••) •••-"), F.right(digits, F.lit(4))))
        .when(has("KEY") | has("TOKEN") | (t == "JWT") | has("SECRET") | has("STRIPE") | has("AZURE"), F.when(n > 8, F.concat(left(4), _dots(n - 8, 14), right(4))).otherwise(F.concat(left(2), _dots(n - 2))))
        .when((t == "CONNECTION_STRING") & (proto > 1), F.concat(F.left(value, proto + 2), F.lit("••••:••••@••••")))
        .when((t == "IP_ADDRESS") & (dot > 1), F.concat(F.left(value, dot - 1), F.lit(".•••.•••.•••")))
        .when(t.isin(*PHRASE_TYPES), F.when(n > 25, F.concat(left(25), F.lit("..."))).otherwise(value))
        .otherwise(rest)
    )


def preview(text: Column, most: int = 120) -> Column:
    """Code blocks named, ends trimmed, cut to ``most`` characters."""
    t = F.trim(F.regexp_replace(text, "(?s)```.*?```", "[code block]"))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(most)), F.lit("...")))


def scan_report(risk: Column, action: Column, findings: Column, changes: Column, latency_ms: Column) -> Column:
    """The report of a dry run as markdown; findings are grouped by category in the order of their first."""
    cats = F.array_distinct(F.transform(findings, lambda f: category(f["validator"])))

    def row(f: Column) -> Column:
        return F.concat(F.lit("| "), severity_icon(f["severity"]), F.lit(" | "), short_label(f["type"]), F.lit(" | `"), masked(f["match"], f["type"]), F.lit("` | "), severity_tag(f["severity"]), F.lit(" | "), percent(f["confidence"]), F.lit(" |\n"))

    def group(c: Column) -> Column:
        own = F.filter(findings, lambda f: category(f["validator"]) == c)
        head = F.concat(F.lit("#### "), chosen(c, CATEGORY_ICON, "⚠️"), F.lit(" "), chosen(c, CATEGORY_LABEL, "Other"), F.lit("\n\n| | Type | Detected Value | Severity | Confidence |\n|---|------|---------------|----------|------------|\n"))
        return F.concat(head, F.array_join(F.transform(own, row), ""), F.lit("\n"))

    found = F.when(F.size(findings) > 0, F.concat(F.lit("### Detected Items\n\n"), F.array_join(F.transform(cats, group), ""))).otherwise(F.lit("*No security risks detected.* ✅\n\n"))
    line = lambda c: F.concat(F.lit("- 🔴 ~~`"), masked(c["original_text"], c["finding"]["type"]), F.lit("`~~ → 🟢 `"), c["replacement"], F.lit("`  *("), short_label(c["finding"]["type"]), F.lit(")*\n"))
    done = F.when(F.size(changes) > 0, F.concat(F.lit("### Redactions Applied\n\n"), F.array_join(F.transform(changes, line), ""), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("## 🔍 Scan Report\n\n"), risk_bar(risk), F.lit("\n\n**Decision:** Would **"), action, F.lit("**\n\n"), found, done, F.lit("*Scan completed in "), latency_ms.cast("string"), F.lit("ms*\n"))


def sanitize_header(risk: Column, changes: Column) -> Column:
    """What a person sees above the answer to a changed text: the risk and every change."""
    one = lambda c: F.concat(severity_icon(c["finding"]["severity"]), F.lit(" **"), short_label(c["finding"]["type"]), F.lit("** detected\n\n> 🔴 ~~`"), masked(c["original_text"], c["finding"]["type"]), F.lit("`~~ → 🟢 `"), c["replacement"], F.lit("`\n\n"))
    found = F.when(F.size(changes) > 0, F.concat(F.lit("### 🔍 Detected & Redacted\n\n"), F.array_join(F.transform(changes, one), ""))).otherwise(F.lit(""))
    return F.concat(F.lit("## ⚠️ Prompt Modified for Safety\n\n"), risk_bar(risk), F.lit("\n\n"), found, F.lit("---\n\n"))


def footer(action: Column) -> Column:
    return F.when(action == "ALLOW", F.lit("\n\n---\n*✅ Verified*\n")).otherwise(F.lit("\n\n---\n*⚠️ Prompt was sanitized before sending to AI*\n"))


def grounding_badge(g: Column) -> Column:
    """One line on how well a response is grounded. ``g``: the struct of ``output.grounding``."""
    n, u = g["counts"]["hallucinated"], g["counts"]["uncertain"]
    head = F.concat(F.lit("\n"), chosen(g["overall_level"], LEVEL_ICON, "⚪"), F.lit(" **Grounding: "), percent(g["overall_score"]), F.lit("** — "))
    parts = F.concat(
        F.when(n > 0, F.concat(F.lit("⚠️ "), n.cast("string"), F.lit(" potentially hallucinated"))).otherwise(F.lit("")), F.when((n > 0) & (u > 0), F.lit(", ")).otherwise(F.lit("")), F.when(u > 0, F.concat(u.cast("string"), F.lit(" uncertain"))).otherwise(F.lit(""))
    )
    return F.when(g["has_hallucination"], F.concat(head, parts, F.lit(" statements detected\n"))).otherwise(F.concat(head, F.lit("All statements appear reliable\n")))


def grounding_report(g: Column) -> Column:
    """The sentence-by-sentence analysis of a response as markdown."""
    reason = lambda r: F.concat(F.lit("  - ⚠️ *"), r, F.lit("*\n"))
    line = lambda s: F.concat(
        chosen(s["level"], LEVEL_ICON, "⚪"), F.lit(" **"), percent(s["confidence"]), F.lit("** — "), preview(s["text"]), F.lit("\n"), F.when(s["level"] != "grounded", F.array_join(F.transform(s["reasons"], reason), "")).otherwise(F.lit(""))
    )
    c = g["counts"]
    counts = F.format_string("🟢 %d grounded · 🟡 %d uncertain · 🔴 %d hallucinated\n\n", c["grounded"], c["uncertain"], c["hallucinated"])
    head = F.concat(F.lit("### 🧠 Hallucination Analysis\n\n**Overall Confidence:** "), chosen(g["overall_level"], LEVEL_ICON, "⚪"), F.lit(" **"), percent(g["overall_score"]), F.lit("** ("), chosen(g["overall_level"], LEVEL_LABEL, "Unknown"), F.lit(")\n\n"), confidence_bar(g["overall_score"]), F.lit("\n\n"))
    return F.concat(head, F.when(g["has_hallucination"], F.concat(counts, F.array_join(F.transform(g["sentences"], line), ""))).otherwise(F.lit("*All statements appear well-grounded.* ✅\n\n")))


def status_report(state: str, settings_lines: list[str], total: Column, allowed: Column, sanitized: Column) -> Column:
    """State, settings and counts in one text."""
    return F.concat(F.lit(f"State: {state}\n" + "".join(f"{x}\n" for x in settings_lines)), F.format_string("Total: %d, allowed: %d, sanitized: %d\n", total, allowed, sanitized))
