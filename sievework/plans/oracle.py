"""The scan in DuckDB SQL, written in rows and groups where the engine works in arrays."""

from __future__ import annotations

from sievework.functions.dialect import END, SPACE, quoted, re2
from sievework.functions.spans import spans_sql
from sievework.operators import rules as R
from sievework.plans.overlay import PHRASES

SOURCES = {
    "documents": "SELECT doc_id AS id, coalesce(text, '') AS text FROM documents",
    "requests": "SELECT request_id AS id, coalesce(llm_output, '') AS text FROM validate_requests",
    "overlay": f"""SELECT id, CASE id % 3 WHEN 0 THEN p || ' ' || c WHEN 1 THEN c || ' ' || p ELSE c || chr(10) || p || ' ' || c END AS text
        FROM (SELECT message_id AS id, coalesce(content, '') AS c, [{", ".join(quoted(p) for p in PHRASES)}][(message_id % {len(PHRASES)} + 1)::INT] AS p FROM backend_messages)""",
}
CHECKS = {
    "": "true",
    "phone": "length(regexp_replace(raw, '[^0-9]', '', 'g')) BETWEEN 10 AND 11",
    "octets": "len(list_filter(string_split(raw, '.'), lambda o: o::INT > 255)) = 0",
    "luhn": """list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN regexp_replace(raw, '[^0-9]', '', 'g')[i]::INT
        WHEN regexp_replace(raw, '[^0-9]', '', 'g')[i]::INT > 4 THEN 2 * regexp_replace(raw, '[^0-9]', '', 'g')[i]::INT - 9 ELSE 2 * regexp_replace(raw, '[^0-9]', '', 'g')[i]::INT END)) % 10 = 0""",
}
DIGITS = "regexp_replace(raw, '[^0-9]', '', 'g')"
SHOW = {
    "SSN": "left(raw, 3) || '-**-' || right(raw, 4)",
    "EMAIL": "left(split_part(raw, '@', 1), 2) || '***@' || split_part(raw, '@', 2)",
    "CREDIT_CARD": f"left({DIGITS}, 4) || '-****-****-' || right({DIGITS}, 4)",
    "PHONE": "left(raw, 3) || '****' || right(raw, 3)",
    "PHONE_INTL": "left(raw, 3) || '****' || right(raw, 3)",
}
SHORT = "CASE WHEN length(raw) > 60 THEN left(raw, 60) || '...' ELSE raw END"


def case(column: str, table: dict, other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v) if isinstance(v, str) else f'{v}::DOUBLE'}" for k, v in table.items()) + f" ELSE {other} END"


def _show(validator: str, kind: str) -> str:
    if validator == "pii":
        return SHOW.get(kind, "CASE WHEN length(raw) > 6 THEN left(raw, 3) || '***' || right(raw, 2) ELSE '***' END")
    if validator == "secrets":
        return "CASE WHEN length(raw) > 8 THEN left(raw, 4) || '***' || right(raw, 2) ELSE '***' END"
    return SHORT


def _escaped(term: str) -> str:
    return "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in term)


def findings(names: tuple[str, ...] = R.VALIDATORS, custom: tuple[str, ...] = ()) -> str:
    """CTEs ``low`` and ``f`` over ``src``: a row per finding, ``ord`` counting them per text."""
    parts = []

    def add(v: str, k: int, select: str) -> None:
        parts.append(f"SELECT {R.VALIDATORS.index(v)} AS vord, {k} AS rord, {quoted(v)} AS validator, * FROM ({select})")

    for v in names:
        for k, r in enumerate(R.RULES.get(v, ())):
            add(v, k, f"""SELECT id, {quoted(r.type)} AS type, {_show(v, r.type)} AS match, position, length, {r.confidence}::DOUBLE AS confidence, {quoted(r.severity)} AS severity
                FROM ({spans_sql("src", re2(r.pattern, r.ignore_case))}) WHERE {CHECKS[r.check]}""")
    if "jailbreak" in names:
        words = " OR ".join(f"contains(lower(d), {quoted(w)})" for w in R.BASE64_KEYWORDS if w == w.lower())
        add("jailbreak", 100, f"""SELECT id, 'BASE64_INJECTION' AS type, '[base64 → "' || CASE WHEN length(d) > 40 THEN left(d, 40) || '...' ELSE d END || '"]' AS match, position, length, 0.9::DOUBLE AS confidence, 'critical' AS severity
            FROM (SELECT *, try(decode(from_base64(b || repeat('=', ((4 - length(b) % 4) % 4)::INT)))) AS d FROM (SELECT *, CASE WHEN length(raw) % 4 = 1 THEN left(raw, length(raw) - 1) ELSE raw END AS b FROM ({spans_sql("src", re2(R.BASE64))})))
            WHERE length(d) > 0 AND length(regexp_replace(d, '[^ -~]', '', 'g')) / length(d) >= 0.7 AND ({words})""")
        add("jailbreak", 101, f"""SELECT id, 'UNICODE_OBFUSCATION' AS type, '[zero-width characters detected at position ' || position || ']' AS match, position, 1::INT AS length, 0.7::DOUBLE AS confidence, 'medium' AS severity
            FROM (SELECT id, (length(regexp_extract(text, {quoted('^([^' + R.ZERO_WIDTH[1:-1] + ']*)')}, 1)))::INT AS position FROM src WHERE regexp_matches(text, {quoted(R.ZERO_WIDTH)}))""")
        add("jailbreak", 102, f"""SELECT id, 'HOMOGLYPH_ATTACK' AS type, '[Cyrillic + Latin script mixing detected — possible homoglyph obfuscation]' AS match, 0::INT AS position, length(text)::INT AS length, 0.6::DOUBLE AS confidence, 'medium' AS severity
            FROM src WHERE regexp_matches(text, {quoted(R.CYRILLIC)}) AND regexp_matches(text, '[a-zA-Z]')""")
    if "toxicity" in names:
        phrases = [(c, s, p, R.TOXIC_CONFIDENCE) for c, (s, ps) in R.TOXIC.items() for p in ps] + [("CUSTOM_BLOCKED", "high", t, R.BLOCKED_CONFIDENCE) for t in custom]
        for k, (c, s, p, conf) in enumerate(phrases):
            shown = "***" if len(p) <= 3 else p[:2] + "*" * max(len(p) - 4, 1) + p[-2:]
            add("toxicity", k, f"SELECT id, {quoted(c)} AS type, {quoted(shown)} AS match, position, {len(p)}::INT AS length, {conf}::DOUBLE AS confidence, {quoted(s)} AS severity FROM ({spans_sql('low', re2(chr(92) + 'b' + _escaped(p) + chr(92) + 'b'))})")
    return f"low AS (SELECT id, lower(text) AS text FROM src), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY vord, rord, position) AS ord FROM ({' UNION ALL '.join(parts)}))"


def scores(names: tuple[str, ...] = R.VALIDATORS, failed: str | None = None) -> str:
    """CTEs ``g`` (scores per text) and ``r`` (risk) over ``src`` and ``f``. ``failed``: SQL condition on id."""
    w = case("severity", R.SEVERITY_WEIGHT, "0.5")
    t = case("severity", R.TOXIC_WEIGHT, "0.5")
    of = lambda v: f"FILTER (validator = '{v}')"
    mean = lambda v: f"least(sum({w} * confidence) {of(v)} / count(*) {of(v)} + least(count(*) {of(v)} * 0.1::DOUBLE, 0.3), 1)"
    how = {
        "pii": mean("pii"),
        "secrets": mean("secrets"),
        "injection": f"least(max(confidence) {of('injection')} + least((count(DISTINCT type) {of('injection')} - 1) * 0.15::DOUBLE, 0.3) + least((count(*) {of('injection')} - 1) * 0.05::DOUBLE, 0.2), 1)",
        "jailbreak": f"""least(greatest(max(confidence) {of('jailbreak')}, CASE WHEN bool_or(type = 'NAMED_JAILBREAK') {of('jailbreak')} THEN 0.95 ELSE 0 END, CASE WHEN bool_or(type = 'BASE64_INJECTION') {of('jailbreak')} THEN 0.9 ELSE 0 END)
            + least((count(DISTINCT type) {of('jailbreak')} - 1) * 0.1::DOUBLE, 0.2), 1)""",
        "toxicity": f"least(max({t} * confidence) {of('toxicity')} + least((count(*) {of('toxicity')} - 1) * 0.1::DOUBLE, 0.2), 1)",
    }
    # least() and greatest() pass over nulls, so a validator without findings is told apart first
    cols = ", ".join(f"CASE WHEN count(*) {of(v)} > 0 THEN {how[v]} END AS {v}" for v in names)
    full = ", ".join(f"coalesce(g.{v}, 0)::DOUBLE AS {v}" for v in names)
    on = failed or "false"
    total = " + ".join(f"{v} * {R.WEIGHTS[v]}::DOUBLE" for v in names)
    base = sum(R.WEIGHTS[v] for v in names)
    total, parts = f"({total} + CASE WHEN {on} THEN 0.4 ELSE 0 END)", f"({base} + CASE WHEN {on} THEN 0.5 ELSE 0 END)"
    best = [(v, f"{v} * {R.WEIGHTS[v]}::DOUBLE") for v in names] + ([("backend", f"CASE WHEN {on} THEN 0.4::DOUBLE ELSE -1 END")] if failed else [])
    top = f"greatest({', '.join(x for _, x in best)})"
    dominant = "CASE " + " ".join(f"WHEN {x} = {top} THEN '{v}'" for v, x in best) + " END"
    return f"""g AS (SELECT id, {cols}, count(*) AS n, bool_or(severity = 'critical') AS critical FROM f GROUP BY id),
        h AS (SELECT src.id, src.text, {full}, coalesce(g.n, 0) + CASE WHEN {on.replace('id', 'src.id')} THEN 1 ELSE 0 END AS n, coalesce(g.critical, false) AS critical FROM src LEFT JOIN g USING (id)),
        r AS (SELECT *, CASE WHEN critical THEN 1.0 ELSE least(greatest({total} / {parts}, 0), 1) END::DOUBLE AS final_score, {dominant} AS dominant, CASE WHEN n = 0 THEN 'ALLOW' ELSE 'SANITIZE' END AS action FROM h)"""


def kept(extra: str = "") -> str:
    """CTE ``k``: per text the findings left after overlaps are resolved, as a list. ``extra``: more rows for f."""
    row = "{'type': type, 'position': position, 'length': length, 'confidence': confidence, 'severity': severity}"
    return f"""k AS (SELECT id, list_reduce(list([{row}] ORDER BY position, length DESC, ord), lambda a, x: CASE WHEN x[1].position >= a[len(a)].position + a[len(a)].length THEN a || x
        WHEN x[1].confidence > a[len(a)].confidence THEN a[1:len(a) - 1] || x ELSE a END) AS kept FROM (SELECT id, type, position, length, confidence, severity, ord FROM f {extra}) GROUP BY id)"""


def clean(text: str) -> str:
    """SQL of the white space clean-up of an expression."""
    s, sp = "chr(57344)", SPACE
    a = f"regexp_replace({text}, '[ \\t]{{2,}}', ' ', 'g')"
    b = f"regexp_replace({a}, '\\n[{sp}]*\\n[{sp}]*\\n', chr(10) || chr(10), 'g')"
    parts = f"string_split(regexp_replace({b}, '(?m)(^[{sp}]+|[{sp}]+$)', {s} || '\\1' || {s}, 'g'), {s})"
    c = f"array_to_string(list_transform({parts}, lambda p, i: CASE WHEN i % 2 = 1 THEN p WHEN contains(p, chr(10)) THEN chr(10) ELSE ' ' END), '')"
    return f"regexp_replace(regexp_replace({c}, '^[{sp}]+', ''), '[{sp}]+$', '')"


def changed() -> str:
    """CTEs ``c`` (handled findings by position, with replacements) and ``z`` (texts after replacement and clean-up)."""
    repl = case("x.type", R.REPLACEMENTS)
    never = ", ".join(quoted(t) for t in R.NEVER_SANITIZED)
    return f"""c AS (SELECT src.id, src.text, coalesce(k.kept, []) AS kept, list_transform(list_filter(coalesce(k.kept, []), lambda x: {repl} IS NOT NULL),
            lambda x: {{'type': x.type, 'position': x.position, 'length': x.length, 'severity': x.severity, 'replacement': {repl}}}) AS ch FROM src LEFT JOIN k USING (id)),
        y AS (SELECT id, text, kept, ch, CASE WHEN len(kept) = 0 THEN text ELSE array_to_string(list_transform(ch, lambda x, i: substring(text, CASE WHEN i = 1 THEN 1 ELSE (ch[i-1].position + ch[i-1].length + 1) END::INT,
            (x.position - CASE WHEN i = 1 THEN 0 ELSE ch[i-1].position + ch[i-1].length END)::INT) || x.replacement), '') || substring(text, CASE WHEN len(ch) = 0 THEN 1 ELSE ch[len(ch)].position + ch[len(ch)].length + 1 END::INT) END AS raw FROM c),
        z AS (SELECT *, CASE WHEN len(kept) = 0 THEN raw ELSE {clean("raw")} END AS sanitized FROM y),
        q AS (SELECT *, CASE WHEN len(kept) = 0 THEN true ELSE NOT (len(list_filter(kept, lambda x: x.type IN ({never}))) > 0 OR regexp_replace(sanitized, '[{SPACE}]', '', 'g') = '') END AS can_sanitize FROM z)"""


def chain(source: str, select: str, *ctes: str) -> str:
    return f"WITH src AS MATERIALIZED ({SOURCES[source]}), {', '.join(ctes)} {select}"


__all__ = ["END", "SOURCES", "case", "chain", "changed", "clean", "findings", "kept", "scores"]
