"""Registered queries of the core, each with its DuckDB equivalent where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import present
from sievework.operators import audit, backend, decide, detect, output, sanitize, score, skew
from sievework.operators import rules as R
from sievework.plans import oracle as O
from sievework.plans.api import Settings, judged, report_columns, scan, status_state, with_findings
from sievework.plans.overlay import overlay
from sievework.sources.shared import shared_folder
from sievework.sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return register


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """(id, text) of documents, requests, or messages with the overlay; null texts are empty."""
    if name == "overlay":
        return overlay(spread(table(spark, sf, "backend_messages").select("message_id", "content")))
    t, i, c = {"documents": ("documents", "doc_id", "text"), "requests": ("validate_requests", "request_id", "llm_output")}[name]
    return spread(table(spark, sf, t).select(F.col(i).alias("id"), F.coalesce(c, F.lit("")).alias("text")))


# ------------------------------------------------------------------------------------------- whole scan
_REPORT = """SELECT r.id, r.n::INT AS n_findings, round(r.final_score, 6) AS risk_score, r.dominant, r.critical, r.action, q.sanitized, q.can_sanitize FROM r JOIN q USING (id)"""


def _scan_query(name: str) -> None:
    whole = O.chain(name, _REPORT, O.findings(), O.scores(), O.kept(), O.changed())

    @query(whole, f"scan_{name}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """Findings, risk, decision and sanitized text of every text."""
        return report_columns(scan(source(spark, sf, name)), "id")

    run.__name__ = f"scan_{name}"


for _name in ("documents", "requests", "overlay"):
    _scan_query(_name)


# ------------------------------------------------------------------------------------------- detectors
def unfolded(found: DataFrame, array: Column | str = "findings") -> DataFrame:
    """(id, the fields of a finding): a row per finding.

    Not by ``inline``: for that the optimiser tests first whether the array is empty, and runs all detectors
    a second time to know.
    """
    return found.select("id", F.inline_outer(array)).where(F.col("type").isNotNull())


def _hits_query(name: str, validator: str, kinds: tuple[str, ...] | None = None, called: str | None = None) -> None:
    where = f"WHERE type IN ({', '.join(O.quoted(k) for k in kinds)})" if kinds else ""
    called = called or f"{validator}_hits_{name}"

    @query(O.chain(name, f"SELECT id, type, match, position, length, confidence, severity FROM f {where}", O.findings((validator,))), called)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """One row per finding of one detector."""
        found = with_findings(source(spark, sf, name), "text", Settings(enabled_validators=(validator,)))
        rows = unfolded(found).drop("validator")
        return rows.where(F.col("type").isin(*kinds)) if kinds else rows

    run.__name__ = called


_hits_query("documents", "pii")
_hits_query("overlay", "pii")
_hits_query("overlay", "pii", ("EMAIL",), "pii_email_spans")
_hits_query("overlay", "pii", ("PHONE", "PHONE_INTL"), "pii_phone_spans")
_hits_query("overlay", "pii", ("CREDIT_CARD",), "pii_card_luhn")
_hits_query("overlay", "pii", ("IP_ADDRESS",), "pii_ip_octets")
_hits_query("overlay", "pii", ("SSN", "DOB", "PASSPORT"), "pii_ssn_dob_passport")
_hits_query("requests", "secrets")
_hits_query("overlay", "secrets")
_hits_query("overlay", "injection")
_hits_query("overlay", "jailbreak")
_hits_query("documents", "jailbreak")
_hits_query("overlay", "jailbreak", ("BASE64_INJECTION",), "base64_payload")
_hits_query("requests", "jailbreak", ("UNICODE_OBFUSCATION",), "zero_width")
_hits_query("requests", "jailbreak", ("HOMOGLYPH_ATTACK",), "script_mixing")
_hits_query("overlay", "toxicity")

CUSTOM = (" Kiln ", "timetable", "", "c++")


@query(O.chain("documents", "SELECT id, type, match, position, length, confidence FROM f WHERE type = 'CUSTOM_BLOCKED'", O.findings(("toxicity",), tuple(detect.blocklist(CUSTOM)))))
def custom_blocklist(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of a user's own terms in documents."""
    found = with_findings(source(spark, sf, "documents"), "text", Settings(enabled_validators=("toxicity",), custom_blocklist=CUSTOM))
    return unfolded(found).where("type = 'CUSTOM_BLOCKED'").select("id", "type", "match", "position", "length", "confidence")


@query("SELECT finding_id, CASE WHEN match_text IS NULL THEN NULL WHEN length(match_text) <= 3 THEN '***' ELSE left(match_text, 2) || repeat('*', greatest(length(match_text) - 4, 1)::INT) || right(match_text, 2) END AS shown FROM findings")
def toxic_term_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Terms as a log may show them."""
    return table(spark, sf, "findings").select("finding_id", detect.mask_term(F.col("match_text")).alias("shown"))


@query(O.chain("overlay", f"SELECT id, {', '.join(f'round({v}, 6) AS {v}' for v in R.VALIDATORS)} FROM r", O.findings(), O.scores()))
def validator_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every validator for every text."""
    s = judged(with_findings(source(spark, sf, "overlay"), "text"))
    return s.select("id", *[F.round(f"s_{v}", 6).alias(v) for v in R.VALIDATORS])


# ------------------------------------------------------------------------------------------ orchestration
@query(O.chain("overlay", "SELECT id, round(final_score, 6) AS risk_score, dominant, n::INT AS n_findings FROM r", O.findings(("pii", "jailbreak")), O.scores(("pii", "jailbreak"))))
def enabled_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Only two validators run; the denominator of the risk shrinks with them."""
    s = scan(source(spark, sf, "overlay"), "text", Settings(enabled_validators=("jailbreak", "pii")))
    return s.select("id", F.round("risk.final_score", 6).alias("risk_score"), "risk.dominant", F.size("findings").alias("n_findings"))


@query(O.chain("overlay", "SELECT id, (ord - 1)::INT AS ord, validator, type, position FROM f", O.findings()))
def flatten_findings(spark: SparkSession, sf: str) -> DataFrame:
    """All findings of a text in one list, in the order of validators and rules."""
    f = with_findings(source(spark, sf, "overlay"), "text").select("id", F.posexplode_outer("findings").alias("ord", "f")).where("ord is not null")
    return f.select("id", "ord", "f.validator", "f.type", "f.position")


@query(O.chain("overlay", "SELECT src.id, coalesce(['low', 'medium', 'high', 'critical'][max(list_position(['low', 'medium', 'high', 'critical'], severity))], 'low') AS severity, count(f.id) > 0 AS detected FROM src LEFT JOIN f USING (id) GROUP BY src.id", O.findings()))
def max_severity(spark: SparkSession, sf: str) -> DataFrame:
    """The highest severity of each text, and whether anything was found."""
    f = with_findings(source(spark, sf, "overlay"), "text")
    return f.select("id", score.highest_severity(F.col("findings")).alias("severity"), (F.size("findings") > 0).alias("detected"))


@query("SELECT request_id FROM validate_requests v WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.request_id = v.request_id)")
def texts_without_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Requests without any recorded finding."""
    return table(spark, sf, "validate_requests").select("request_id").join(table(spark, sf, "findings"), "request_id", "left_anti")


@query("SELECT request_id FROM validate_requests v WHERE EXISTS (SELECT 1 FROM findings f WHERE f.request_id = v.request_id AND lower(f.severity) = 'critical')")
def texts_with_critical(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with a recorded critical finding."""
    f = table(spark, sf, "findings").where(F.lower("severity") == "critical")
    return table(spark, sf, "validate_requests").select("request_id").join(f, "request_id", "left_semi")


# ---------------------------------------------------------------------------------------------- sanitizing
@query(O.chain("overlay", "SELECT id, x.type, x.position, x.length, x.confidence FROM (SELECT id, unnest(kept) AS x FROM k)", O.findings(), O.kept()))
def dedupe_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Findings left after overlaps are resolved."""
    f = with_findings(source(spark, sf, "overlay"), "text")
    return unfolded(f, sanitize.deduplicated(F.col("findings"))).select("id", "type", "position", "length", "confidence")


@query(O.chain("documents", "SELECT id, sanitized FROM q", O.findings(("pii",)), O.kept(), O.changed()))
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with personal data replaced."""
    return scan(source(spark, sf, "documents"), "text", Settings(enabled_validators=("pii",))).select("id", "sanitized")


@query(O.chain("overlay", "SELECT id, sanitized, can_sanitize FROM q", O.findings(("injection", "jailbreak")), O.kept(), O.changed()))
def strip_injection(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with injected phrases removed, and whether anything is left."""
    return scan(source(spark, sf, "overlay"), "text", Settings(enabled_validators=("injection", "jailbreak"))).select("id", "sanitized", "can_sanitize")


@query(f"SELECT id, {O.clean('text')} AS cleaned FROM ({O.SOURCES['documents']})")
def whitespace_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """The clean-up alone, on every document."""
    return source(spark, sf, "documents").select("id", sanitize.cleaned(F.col("text")).alias("cleaned"))


@query(O.chain("overlay", "SELECT id, x.type, x.replacement, x.position, substring(text, (x.position + 1)::INT, x.length::INT) AS original_text FROM (SELECT id, text, unnest(ch) AS x FROM c)", O.findings(), O.kept(), O.changed()))
def change_log(spark: SparkSession, sf: str) -> DataFrame:
    """One row per change."""
    s = scan(source(spark, sf, "overlay"))
    return s.select("id", F.explode_outer("changes").alias("c")).where("c is not null").select("id", "c.finding.type", "c.replacement", "c.position", "c.original_text")


# ---------------------------------------------------------------------------------------- risk and decision
_REASON = f"""SELECT q.id, r.action, CASE WHEN r.action = 'ALLOW' THEN 'Prompt passed all security checks.' ELSE (CASE WHEN r.critical THEN '⚠️ Critical risk detected — prompt masked for safety' ELSE 'Prompt modified for safety' END) || ': '
    || coalesce((SELECT string_agg(n || ' ' || {O.case("type", R.REASON_LABELS, "replace(lower(type), '_', ' ')")} || CASE WHEN n > 1 THEN 's' ELSE '' END || ' masked', ', ' ORDER BY last DESC)
        FROM (SELECT x.type AS type, count(*) AS n, max(x.position) AS last FROM (SELECT unnest(q.ch) AS x) GROUP BY x.type)), '') || '.' END AS reason FROM q JOIN r USING (id)"""


@query(O.chain("overlay", _REASON, O.findings(), O.scores(), O.kept(), O.changed()))
def decision_reason(spark: SparkSession, sf: str) -> DataFrame:
    """Decision and its reason in words."""
    return scan(source(spark, sf, "overlay")).select("id", "action", "reason")


@query(O.chain("overlay", f"SELECT id, validator, round(s, 6) AS score FROM (UNPIVOT (SELECT id, {', '.join(R.VALIDATORS)} FROM r) ON {', '.join(R.VALIDATORS)} INTO NAME validator VALUE s)", O.findings(), O.scores()))
def score_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by validator in rows, from the map of the risk."""
    return scan(source(spark, sf, "overlay")).select("id", F.explode_outer("risk.breakdown").alias("validator", "s")).select("id", "validator", F.round("s", 6).alias("score"))


@query(O.chain("requests", "SELECT dominant, action, count(*) AS texts, round(avg(final_score), 6) AS mean_risk, count(*) FILTER (critical) AS critical FROM r GROUP BY ALL", O.findings(), O.scores()))
def risk_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and mean risk by what dominates them."""
    s = scan(source(spark, sf, "requests"))
    return s.groupBy("risk.dominant", "action").agg(F.count("*").alias("texts"), F.round(F.avg("risk.final_score"), 6).alias("mean_risk"), F.count_if(F.col("risk.critical")).alias("critical"))


# ------------------------------------------------------------------------------------------ remote guard
def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in for a remote guard: every fifth text fails, every seventh has no answer."""
    i = F.col("message_id")
    return table(spark, sf, "backend_messages").select(i.alias("id"), (i % 7 != 0).alias("available"), (i % 5 != 0).alias("passed"))


_FLAG = "UNION ALL SELECT id, 'BACKEND_FLAG' AS type, 0 AS position, length(text) AS length, 0.9 AS confidence, 'high' AS severity, 1000000 AS ord FROM src WHERE id % 7 <> 0 AND id % 5 = 0"


@query(O.chain("overlay", "SELECT r.id, r.id % 7 <> 0 AS backend_used, r.n::INT AS n_findings, round(r.final_score, 6) AS risk_score, r.dominant, r.action, q.sanitized FROM r JOIN q USING (id)", O.findings(), O.scores(failed="(id % 7 <> 0 AND id % 5 = 0)"), O.kept(_FLAG), O.changed()))
def backend_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Scan with a remote guard's verdicts merged in."""
    m = backend.merged(source(spark, sf, "overlay"), _verdicts(spark, sf), "id")
    s = scan(m, "text", Settings(), failed="backend_failed")
    return s.select("id", "backend_used", F.size("findings").alias("n_findings"), F.round("risk.final_score", 6).alias("risk_score"), "risk.dominant", "action", "sanitized")


_ANSWERS = """SELECT outcome_id, CASE WHEN outcome_id % 2 = 0 THEN json_object('callId', call_id, 'rawLlmOutput', raw_llm_output, 'validatedOutput', validated_output, 'validationPassed', validation_passed, 'error', error)
    ELSE json_object('call_id', call_id, 'raw_llm_output', raw_llm_output, 'validated_output', validated_output, 'validation_passed', validation_passed, 'error', error) END AS j FROM validation_outcomes"""


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes as JSON answers, in both spellings of the names by turns."""
    o = table(spark, sf, "validation_outcomes")
    cols = ["call_id", "raw_llm_output", "validated_output", "validation_passed", "error"]
    camel = ["callId", "rawLlmOutput", "validatedOutput", "validationPassed", "error"]
    one = F.to_json(F.struct(*[F.col(c).alias(n) for c, n in zip(cols, camel, strict=True)]))
    return o.select("outcome_id", F.when(F.col("outcome_id") % 2 == 0, one).otherwise(F.to_json(F.struct(*cols))).alias("answer"))


@query("SELECT outcome_id, coalesce(call_id, '') AS call_id, raw_llm_output AS raw, validated_output AS validated, coalesce(validation_passed, false) AS passed, nullif(error, '') AS error FROM validation_outcomes")
def response_parse(spark: SparkSession, sf: str) -> DataFrame:
    """JSON answers read back in either spelling."""
    return _answers(spark, sf).select("outcome_id", backend.parsed(F.col("answer")).alias("r")).select("outcome_id", "r.*")


@query(
    """SELECT outcome_id, CASE WHEN raw IS NULL OR length(raw) % 5 <> 0 THEN NULL ELSE 'ToxicLanguage failed' END AS error, CASE WHEN raw IS NOT NULL AND length(raw) % 5 = 0 THEN NULL WHEN length(raw) % 3 = 0 THEN '[fixed]' ELSE raw END AS validated,
    array_to_string(list_filter([CASE WHEN length(raw) % 3 = 0 THEN 'DetectPII' END, CASE WHEN length(raw) % 5 = 0 THEN 'ToxicLanguage' END, CASE WHEN length(raw) % 2 = 0 THEN 'UnusualPrompt' END], lambda x: x IS NOT NULL), ',') AS flagged
    FROM (SELECT outcome_id, raw_llm_output AS raw FROM validation_outcomes)"""
)
def guard_policies(spark: SparkSession, sf: str) -> DataFrame:
    """fix, exception and noop applied to outcomes; a stand-in decides by length."""
    n = F.coalesce(F.length("raw_llm_output"), F.lit(1))
    done = backend.applied(F.col("raw_llm_output"), [("DetectPII", "fix", n % 3 != 0, F.lit("[fixed]")), ("ToxicLanguage", "exception", n % 5 != 0, F.lit(None).cast("string")), ("UnusualPrompt", "noop", n % 2 != 0, F.lit(None).cast("string"))])
    return table(spark, sf, "validation_outcomes").select("outcome_id", done.alias("d")).select("outcome_id", "d.error", "d.validated", F.array_join("d.flagged", ",").alias("flagged"))


@query(
    """SELECT outcome_id, NOT bad AS passed, CASE WHEN NOT bad THEN cur END AS validated, CASE WHEN bad THEN 'ToxicLanguage failed' END AS error,
    concat_ws(',', CASE WHEN contains(t, '@') THEN 'DetectPII' END, CASE WHEN bad THEN 'ToxicLanguage' END) AS flagged
    FROM (SELECT *, contains(lower(cur), 'kill') AS bad FROM (SELECT outcome_id, t, replace(t, '@', '[at]') AS cur FROM (SELECT outcome_id, coalesce(raw_llm_output, '') AS t FROM validation_outcomes)))"""
)
def guard_models(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes through model scorers in Python workers; stand-ins for models that aren't at hand."""

    def pii():
        return lambda texts: [("@" not in t, t.replace("@", "[at]")) for t in texts]

    def toxic():
        return lambda texts: [("kill" not in t.lower(), None) for t in texts]

    done = backend.guarded(table(spark, sf, "validation_outcomes"), "outcome_id", "raw_llm_output", [("DetectPII", "fix", pii), ("ToxicLanguage", "exception", toxic)])
    return done.withColumn("flagged", F.array_join("flagged", ","))


def _grounding(spark: SparkSession, sf: str) -> DataFrame:
    r = _answers(spark, sf).select("outcome_id", backend.parsed(F.col("answer")).alias("r"))
    v = r.withColumn("v", backend.extracted(F.col("r")))
    g = output.grounding(F.coalesce("r.raw", F.lit("")), F.col("outcome_id") % 11 != 0, F.col("r.passed"), backend.hallucination_score(F.col("v")), F.col("v"))
    return v.select("outcome_id", g.alias("g"))


_G = "SELECT outcome_id, outcome_id % 11 <> 0 AS a, coalesce(validation_passed, false) AS p, coalesce(validation_passed, false) AND nullif(error, '') IS NULL AS ok, nullif(error, '') AS e, coalesce(raw_llm_output, '') AS t FROM validation_outcomes"


@query(f"SELECT outcome_id, 1.0::DOUBLE AS overall_score, 'grounded' AS overall_level, 1::INT AS grounded, 0::INT AS uncertain, CASE WHEN a AND NOT ok THEN 1 ELSE 0 END::INT AS hallucinated, a AND NOT p AS has_hallucination FROM ({_G})")
def grounding_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Grounding of responses, and sentences per level."""
    return _grounding(spark, sf).select("outcome_id", "g.overall_score", "g.overall_level", "g.counts.*", "g.has_hallucination")


@query(
    f"""SELECT outcome_id, 0::INT AS n, CASE WHEN NOT a THEN '{output.UNAVAILABLE}' WHEN length(t) > 200 THEN left(t, 200) || '...' ELSE t END AS text, 1.0::DOUBLE AS confidence, 'grounded' AS level FROM ({_G})
    UNION ALL SELECT outcome_id, 1, '[backend: ' || coalesce(e, 'validation failed') || ']', 0.3, 'hallucinated' FROM ({_G}) WHERE a AND NOT ok"""
)
def grounding_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences of the grounding report."""
    return _grounding(spark, sf).select("outcome_id", F.posexplode("g.sentences").alias("n", "s")).select("outcome_id", "n", "s.text", "s.confidence", "s.level")


@query("SELECT request_id, string_agg(coalesce(content, ''), '' ORDER BY turn_no, message_id) AS response FROM backend_messages WHERE request_id IS NOT NULL AND lower(msg_role) = 'assistant' GROUP BY request_id")
def response_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Responses put together from their chunks in order."""
    m = table(spark, sf, "backend_messages").where(F.col("request_id").isNotNull() & (F.lower("msg_role") == "assistant"))
    seq = F.struct(F.struct("turn_no", "message_id").alias("seq"), F.coalesce("content", F.lit("")).alias("chunk"))
    return m.groupBy("request_id").agg(output.assembled(F.collect_list(seq)).alias("response"))


# ------------------------------------------------------------------------------------------------- audit
@query("SELECT request_id, sha256(llm_output) AS prompt_hash FROM validate_requests")
def prompt_hash(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256 of every request."""
    return table(spark, sf, "validate_requests").select("request_id", audit.prompt_hash(F.col("llm_output")).alias("prompt_hash"))


@query("SELECT a.entry_id, v.request_id FROM audit_entries a JOIN (SELECT sha256(llm_output) AS h, min(request_id) AS request_id FROM validate_requests WHERE llm_output IS NOT NULL GROUP BY 1) v ON a.prompt_hash = v.h")
def audit_to_request(spark: SparkSession, sf: str) -> DataFrame:
    """Entries traced to the first request with their hash. One hash may hold a tenth of all entries: hot hashes are joined by broadcast within a bound."""
    v = table(spark, sf, "validate_requests").where(F.col("llm_output").isNotNull()).groupBy(audit.prompt_hash(F.col("llm_output")).alias("prompt_hash")).agg(F.min("request_id").alias("request_id"))
    return skew.join_unique(table(spark, sf, "audit_entries").select("entry_id", "prompt_hash"), v, ["prompt_hash"]).select("entry_id", "request_id")


@query(
    O.chain("overlay", "SELECT sha256(src.text) AS prompt_hash, lower(r.action) AS decision, round(r.final_score, 6) AS risk_score, coalesce(string_agg(f.type || '/' || f.severity || '/' || f.validator, ';' ORDER BY f.ord), '') AS findings FROM src JOIN r USING (id) LEFT JOIN f USING (id) GROUP BY src.id, src.text, r.action, r.final_score", O.findings(), O.scores())
)
def audit_build(spark: SparkSession, sf: str) -> DataFrame:
    """Audit entries of a scan: hashes and summaries, never the text."""
    e = audit.entries(scan(source(spark, sf, "overlay")), "text", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    shown = F.array_join(F.transform("findings", lambda f: F.concat_ws("/", f["type"], f["severity"], f["validator"])), ";")
    return e.select(F.col("promptHash").alias("prompt_hash"), "decision", F.round("riskScore", 6).alias("risk_score"), shown.alias("findings"))


_NORM = "lower(trim(decision, ' '))"


@query(f"SELECT count(*) AS total, count(*) FILTER ({_NORM} = 'allow') AS allowed, count(*) FILTER ({_NORM} = 'sanitize') AS sanitized FROM audit_entries")
def audit_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Entries in all, allowed and sanitized."""
    return audit.stats(table(spark, sf, "audit_entries"))


@query(f"SELECT received_at::DATE AS day, count(*) AS total, count(*) FILTER ({_NORM} = 'allow') AS allowed, count(*) FILTER ({_NORM} = 'sanitize') AS sanitized FROM audit_entries GROUP BY 1")
def audit_stats_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """The same per day of arrival."""
    return audit.stats(table(spark, sf, "audit_entries").withColumn("day", F.to_date("received_at")), "day")


@query("SELECT entry_id, prompt_hash, decision, received_at AT TIME ZONE 'UTC' AS received_at FROM audit_entries ORDER BY audit_entries.received_at DESC, entry_id DESC LIMIT 100")
def audit_recent(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred newest entries; a top-k, so no full sort."""
    return table(spark, sf, "audit_entries").select("entry_id", "prompt_hash", "decision", "received_at").orderBy(F.desc("received_at"), F.desc("entry_id")).limit(100)


@query("SELECT x.validator, x.finding_type, count(*) AS n, count(DISTINCT prompt_hash) AS prompts FROM (SELECT prompt_hash, unnest(findings) AS x FROM audit_entries) GROUP BY ROLLUP (x.validator, x.finding_type)")
def audit_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Findings by validator and type, with subtotals."""
    f = table(spark, sf, "audit_entries").select("prompt_hash", F.inline("findings"))
    return f.rollup("validator", "finding_type").agg(F.count("*").alias("n"), F.count_distinct("prompt_hash").alias("prompts"))


@query(
    """SELECT entry_id, upper(left(decision, 1)) || substring(decision, 2) AS badge, CASE WHEN len(findings) > 0 THEN array_to_string(list_transform(findings, lambda f: f.finding_type || ' (' || f.severity || ')'), ', ') ELSE 'None' END AS found,
    CASE WHEN isnan(risk_score) THEN NULL ELSE floor(risk_score * 100 + 0.5)::INT END AS pct, CASE WHEN isnan(risk_score) THEN NULL WHEN risk_score < 0.3 THEN '#4a4' WHEN risk_score < 0.7 THEN '#cc4' WHEN risk_score IS NULL THEN '#c44' ELSE '#c44' END AS color FROM audit_entries"""
)
def audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Entries as the log's viewer shows them; a score that is no number has no bar."""
    a = table(spark, sf, "audit_entries")
    s = F.when(~F.isnan("risk_score"), F.col("risk_score"))
    b = audit.score_bar(s)
    color = F.when(F.isnan("risk_score"), F.lit(None).cast("string")).otherwise(b["color"])
    return a.select("entry_id", audit.badge(F.col("decision")).alias("badge"), audit.finding_text(F.col("findings"), "finding_type").alias("found"), b["pct"].alias("pct"), color.alias("color"))


@query("SELECT entry_id, '[' || strftime(received_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z] [INFO] Decision: ' || coalesce(decision, 'null') || ' (latency: ' || coalesce(latency_ms::VARCHAR, 'null') || 'ms)' AS line FROM audit_entries")
def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Entries as lines of a log."""
    said = F.format_string("Decision: %s (latency: %sms)", "decision", F.col("latency_ms").cast("string"))
    return table(spark, sf, "audit_entries").select("entry_id", audit.log_line(F.col("received_at"), F.lit("INFO"), said).alias("line"))


@query(f"SELECT count(*) AS total, round(count(*) FILTER ({_NORM} = 'sanitize') / count(*), 6) AS share_sanitized, round(count(*) FILTER (backend_used) / count(*), 6) AS availability, round(avg(latency_ms) FILTER (latency_ms >= 0), 6) AS mean_latency, max(latency_ms) AS worst_latency FROM audit_entries")
def success_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Stated measures of success over the whole log."""
    d, n = F.lower(F.trim("decision")), F.count("*")
    return table(spark, sf, "audit_entries").agg(
        n.alias("total"), F.round(F.count_if(d == "sanitize") / n, 6).alias("share_sanitized"), F.round(F.count_if("backend_used") / n, 6).alias("availability"), F.round(F.avg(F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))), 6).alias("mean_latency"), F.max("latency_ms").alias("worst_latency")
    )


@query("SELECT prompt_hash, count(*) AS entries, count(DISTINCT lower(trim(decision, ' '))) AS decisions, min(received_at) AT TIME ZONE 'UTC' AS first_at, max(received_at) AT TIME ZONE 'UTC' AS last_at FROM audit_entries GROUP BY 1")
def audit_by_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """History of every prompt. Counts are pre-aggregated by decision, so a hash with a third of all rows is a few rows per task before the shuffle."""
    a = table(spark, sf, "audit_entries").groupBy("prompt_hash", F.lower(F.trim("decision")).alias("d")).agg(F.count("*").alias("n"), F.min("received_at").alias("a"), F.max("received_at").alias("b"))
    return a.groupBy("prompt_hash").agg(F.sum("n").alias("entries"), F.count("d").alias("decisions"), F.min("a").alias("first_at"), F.max("b").alias("last_at"))


@query("SELECT entry_id, row_number() OVER (PARTITION BY received_at::DATE ORDER BY received_at, entry_id) AS n, (row_number() OVER (PARTITION BY received_at::DATE ORDER BY received_at, entry_id) % 2)::INT AS zebra FROM audit_entries")
def audit_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Entries numbered within their day, with the stripe of their row."""
    rows = table(spark, sf, "audit_entries").select("entry_id", "received_at", F.to_date("received_at").alias("day"))
    return skew.numbered(rows, "day", ["received_at", "entry_id"]).select("entry_id", "n").withColumn("zebra", (F.col("n") % 2).cast("int"))


@query(f"SELECT date_trunc('hour', received_at AT TIME ZONE 'UTC') AS start, {_NORM} AS decision, count(*) AS n FROM audit_entries GROUP BY ALL")
def audit_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows of an hour."""
    a = table(spark, sf, "audit_entries").withColumn("decision", F.lower(F.trim("decision")))
    return a.groupBy(F.window("received_at", "1 hour").alias("w"), "decision").agg(F.count("*").alias("n")).select("w.start", "decision", "n")


# ------------------------------------------------------------------------------------- files and streams
def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in shared storage, beside the checkpoints."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _as_entries(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "audit_entries")
    f = F.transform("findings", lambda x: F.struct(x["finding_type"].alias("type"), x["severity"].alias("severity"), x["validator"].alias("validator")))
    score_ = F.when(~F.isnan("risk_score"), F.col("risk_score"))  # JSON has no NaN
    return a.select(F.col("entry_ts").alias("timestamp"), F.col("prompt_hash").alias("promptHash"), "decision", score_.alias("riskScore"), f.alias("findings"), F.col("backend_used").alias("backendUsed"), F.col("latency_ms").alias("latencyMs"))


@query("SELECT count(*) AS n, count(DISTINCT prompt_hash) AS prompts, sum(latency_ms)::BIGINT AS latency, sum(len(findings))::BIGINT AS findings FROM audit_entries")
def audit_jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """All entries written as JSON lines and read back."""
    path = _folder(spark, "audit")
    audit.append(_as_entries(spark, sf), path)
    return audit.read(spark, path).agg(F.count("*").alias("n"), F.count_distinct("promptHash").alias("prompts"), F.sum("latencyMs").alias("latency"), F.sum(F.size("findings").cast("long")).alias("findings"))


@query(O.chain("overlay", "SELECT lower(action) AS decision, count(*) AS n, round(sum(final_score), 4) AS risk FROM r GROUP BY 1", O.findings(), O.scores()))
def stream_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as a stream: scanned, audited as JSON lines, and summed up."""
    from sievework.streaming.pipeline import scan_to_audit

    path, source_dir = _folder(spark, "stream-audit"), _folder(spark, "stream-source")
    table(spark, sf, "backend_messages").write.parquet(source_dir)
    messages = spark.readStream.schema(table(spark, sf, "backend_messages").schema).parquet(source_dir)
    texts = overlay(messages).withColumn("at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    scan_to_audit(texts, "text", "at", path, _folder(spark, "stream-state"), Settings()).awaitTermination()
    return audit.read(spark, path).groupBy("decision").agg(F.count("*").alias("n"), F.round(F.sum("riskScore"), 4).alias("risk"))


# ------------------------------------------------------------------------------------------ presentation
_PCT = lambda s: f"floor({s} * 100 + 0.5)::BIGINT || '%'"


@query(
    O.chain("overlay", f"""SELECT id, '**Risk:** `' || {_PCT("final_score")} || '` ' || repeat(CASE WHEN final_score >= 0.7 THEN '🟥' WHEN final_score >= 0.3 THEN '🟨' ELSE '🟩' END, floor(final_score * 20 + 0.5)::INT) || repeat('⬜', (20 - floor(final_score * 20 + 0.5))::INT)
    || ' *' || CASE WHEN final_score < 0.3 THEN 'Low' WHEN final_score < 0.7 THEN 'Medium' ELSE 'High' END || '*' AS bar FROM (SELECT id, round(final_score, 6) AS final_score FROM r)""", O.findings(), O.scores())
)
def risk_bar(spark: SparkSession, sf: str) -> DataFrame:
    """The risk of every text as a bar of twenty cells."""
    return scan(source(spark, sf, "overlay")).select("id", present.risk_bar(F.round("risk.final_score", 6)).alias("bar"))


@query(O.chain("overlay", "SELECT id, validator AS category, min(ord) AS first, count(*) AS n, max(confidence) AS best FROM f GROUP BY id, validator", O.findings()))
def category_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of each text by category, with the place of the first."""
    f = with_findings(source(spark, sf, "overlay"), "text").select("id", F.posexplode_outer("findings").alias("ord", "f")).where("ord is not null")
    return f.groupBy("id", present.category(F.col("f.validator")).alias("category")).agg((F.min("ord") + 1).cast("long").alias("first"), F.count("*").alias("n"), F.max("f.confidence").alias("best"))


def _mask_sql() -> str:
    v, t, d = "v", "upper(k)", "regexp_replace(v, '[^0-9]', '', 'g')"
    phrases = ", ".join(O.quoted(x) for x in present.PHRASE_TYPES)
    return f"""CASE WHEN v IS NULL OR length(v) < 4 THEN '••••' WHEN {t} = 'SSN' THEN left(v, 3) || '-••-••••' WHEN {t} = 'EMAIL' THEN CASE WHEN strpos(v, '@') > 3 THEN left(v, 2) || '••' || substring(v, strpos(v, '@')::INT) ELSE left(v, 2) || '••••' END
        WHEN {t} = 'CREDIT_CARD' THEN '••••-••••-••••-' || right({d}, 4) WHEN contains({t}, 'PHONE') THEN '(•••) •••-' || right({d}, 4)
        WHEN contains({t}, 'KEY') OR contains({t}, 'TOKEN') OR {t} = 'JWT' OR contains({t}, 'SECRET') OR contains({t}, 'STRIPE') OR contains({t}, 'AZURE') THEN CASE WHEN length(v) > 8 THEN left(v, 4) || repeat('•', least(length(v) - 8, 14)::INT) || right(v, 4) ELSE left(v, 2) || repeat('•', (length(v) - 2)::INT) END
        WHEN {t} = 'CONNECTION_STRING' AND strpos(v, '://') > 1 THEN left(v, strpos(v, '://') + 2) || '••••:••••@••••' WHEN {t} = 'IP_ADDRESS' AND strpos(v, '.') > 1 THEN left(v, strpos(v, '.') - 1) || '.•••.•••.•••'
        WHEN {t} IN ({phrases}) THEN CASE WHEN length(v) > 25 THEN left(v, 25) || '...' ELSE v END WHEN length(v) > 10 THEN left(v, 4) || repeat('•', least(length(v) - 8, 10)::INT) || right(v, 4) ELSE left(v, 2) || repeat('•', (length(v) - 2)::INT) END"""


@query(f"SELECT change_id, {_mask_sql()} AS shown FROM (SELECT change_id, original_text AS v, coalesce(finding_type, '') AS k FROM sanitize_changes)")
def feedback_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Original texts of changes, masked by their stated type."""
    return table(spark, sf, "sanitize_changes").select("change_id", present.masked(F.col("original_text"), F.coalesce("finding_type", F.lit(""))).alias("shown"))


@query(f"SELECT finding_id, {O.case('finding_type', R.REASON_LABELS, chr(39).join(['replace(lower(finding_type), ', '_', ', ', ' ', ')']))} AS label, {O.case('finding_type', R.SHORT_LABELS, chr(39).join(['replace(lower(finding_type), ', '_', ', ', ' ', ')']))} AS short_label, CASE severity WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' WHEN 'low' THEN '🟢' ELSE '⚪' END AS icon FROM findings")
def human_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Types of findings in words, and icons of severities."""
    return table(spark, sf, "findings").select("finding_id", decide.label(F.col("finding_type")).alias("label"), present.short_label(F.col("finding_type")).alias("short_label"), present.severity_icon(F.col("severity")).alias("icon"))


@query("SELECT request_id, CASE WHEN length(t) <= 120 THEN t ELSE left(t, 120) || '...' END AS preview FROM (SELECT request_id, trim(regexp_replace(llm_output, '(?s)```.*?```', '[code block]', 'g'), ' ') AS t FROM validate_requests)")
def preview_text(spark: SparkSession, sf: str) -> DataFrame:
    """Requests cut for display."""
    return table(spark, sf, "validate_requests").select("request_id", present.preview(F.col("llm_output")).alias("preview"))


@query(O.chain("overlay", "SELECT id, CASE WHEN n = 0 AND final_score < 0 THEN 'ALLOW' ELSE 'SANITIZE' END AS at_zero, CASE WHEN n = 0 AND final_score < 0.7 THEN 'ALLOW' ELSE 'SANITIZE' END AS at_high FROM r", O.findings(), O.scores()))
def decision_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """The decision at other thresholds: at 0 even a clean text is changed."""
    s = scan(source(spark, sf, "overlay"))
    return s.select("id", decide.action(F.col("findings"), F.col("risk.final_score"), 0.0).alias("at_zero"), decide.action(F.col("findings"), F.col("risk.final_score"), 0.7).alias("at_high"))


@query(O.chain("overlay", "SELECT id, type, match FROM f WHERE type IN ('SSN', 'EMAIL', 'PHONE', 'PHONE_INTL', 'CREDIT_CARD', 'IP_ADDRESS', 'PASSPORT', 'DOB')", O.findings(("pii",))))
def pii_display_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Personal values as a log may show them."""
    return unfolded(with_findings(source(spark, sf, "overlay"), "text", Settings(enabled_validators=("pii",)))).select("id", "type", "match")


@query(
    f"""SELECT outcome_id, CASE WHEN s >= 0.7 THEN '🟢' WHEN s >= 0.4 THEN '🟡' ELSE '🔴' END AS icon, CASE WHEN s >= 0.7 THEN 'Well-grounded' WHEN s >= 0.4 THEN 'Some uncertainty' ELSE 'Likely hallucinated' END AS label,
    '`' || {_PCT("s")} || '` ' || repeat(CASE WHEN s >= 0.7 THEN '🟩' WHEN s >= 0.4 THEN '🟨' ELSE '🟥' END, floor(s * 20 + 0.5)::INT) || repeat('⬜', (20 - floor(s * 20 + 0.5))::INT) AS bar FROM (SELECT outcome_id, (outcome_id % 21)::DOUBLE / 20 AS s FROM validation_outcomes)"""
)
def grounding_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Icons, labels and bars of confidence; scores stand in for a model's."""
    s = (F.col("outcome_id") % 21).cast("double") / 20
    level = output.level(s)
    return table(spark, sf, "validation_outcomes").select("outcome_id", present.chosen(level, present.LEVEL_ICON, "⚪").alias("icon"), present.chosen(level, present.LEVEL_LABEL, "Unknown").alias("label"), present.confidence_bar(s).alias("bar"))


@query(
    f"""SELECT outcome_id, chr(10) || '🟢 **Grounding: 100%** — ' || CASE WHEN NOT (a AND NOT p) THEN 'All statements appear reliable' ELSE CASE WHEN NOT ok THEN '⚠️ 1 potentially hallucinated' ELSE '' END || ' statements detected' END || chr(10) AS badge FROM ({_G})"""
)
def grounding_badges(spark: SparkSession, sf: str) -> DataFrame:
    """One line per response on how well it is grounded."""
    return _grounding(spark, sf).select("outcome_id", present.grounding_badge(F.col("g")).alias("badge"))


def _pct(score: str) -> str:
    return f"floor({score} * 100 + 0.5)::BIGINT || '%'"


def _preview(text: str) -> str:
    t = f"trim(regexp_replace({text}, '(?s)```.*?```', '[code block]', 'g'), ' ')"
    return f"CASE WHEN length({t}) <= 120 THEN {t} ELSE left({t}, 120) || '...' END"


def _risk_bar_sql(score: str) -> str:
    return f"""'**Risk:** `' || {_pct(score)} || '` ' || repeat(CASE WHEN {score} >= 0.7 THEN '🟥' WHEN {score} >= 0.3 THEN '🟨' ELSE '🟩' END, floor({score} * 20 + 0.5)::INT) || repeat('⬜', (20 - floor({score} * 20 + 0.5))::INT)
        || ' *' || CASE WHEN {score} < 0.3 THEN 'Low' WHEN {score} < 0.7 THEN 'Medium' ELSE 'High' END || '*'"""


def _answered(spark: SparkSession, sf: str) -> DataFrame:
    """(outcome_id, g): groundings of answers that name their validators; stand-ins by turns of five.

    The guard's one validation; a hallucination validator that failed with a score of its own, or without one;
    a bias validator that failed; a hallucination validator that passed beside another that failed.
    """
    i = F.col("outcome_id")
    one = lambda name, passed, error, meta: F.struct(F.lit(name).alias("validator_name"), F.lit(passed).alias("passed"), F.lit(error).cast("string").alias("error_message"), meta.cast("map<string,double>").alias("metadata"))
    no = F.lit(None)
    named = (
        F.when(i % 5 == 1, F.array(one("GroundedAIHallucination", False, None, F.create_map(F.lit("hallucination_score"), (i % 10).cast("double") / 10)))).when(i % 5 == 2, F.array(one("GroundedAIHallucination", False, "made up", no)))
        .when(i % 5 == 3, F.array(one("BiasCheck", False, "biased", no))).when(i % 5 == 4, F.array(one("GroundedAIHallucination", True, None, no), one("ToxicLanguage", False, None, no)))
    )
    r = _answers(spark, sf).select("outcome_id", backend.parsed(F.col("answer")).alias("r"))
    v = r.withColumn("v", F.coalesce(named.cast(backend.VALIDATIONS), backend.extracted(F.col("r"))))
    g = output.grounding(F.coalesce("r.raw", F.lit("")), i % 11 != 0, F.when(i % 5 == 0, F.col("r.passed")).otherwise(F.lit(True)), backend.hallucination_score(F.col("v")), F.col("v"))
    return v.select("outcome_id", g.alias("g"))


# a row per sentence: score, level, text, reason
_SAID = f"""o AS (SELECT outcome_id, outcome_id % 11 <> 0 AS a, outcome_id % 5 AS k, coalesce(raw_llm_output, '') AS t, nullif(error, '') AS e, CASE WHEN outcome_id % 5 = 0 THEN coalesce(validation_passed, false) ELSE true END AS p,
        1.0::DOUBLE - CASE outcome_id % 5 WHEN 1 THEN (outcome_id % 10)::DOUBLE / 10 WHEN 2 THEN 0.8::DOUBLE WHEN 4 THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS s FROM validation_outcomes),
    w AS (SELECT *, CASE WHEN s >= 0.7 THEN 'grounded' WHEN s >= 0.4 THEN 'uncertain' ELSE 'hallucinated' END AS whole, NOT p OR k IN (1, 2) AS bad, k = 0 AND NOT (p AND e IS NULL) AS other FROM o),
    y AS (SELECT outcome_id, 1 AS n, CASE WHEN NOT a THEN '{output.UNAVAILABLE}' WHEN length(t) > 200 THEN left(t, 200) || '...' ELSE t END AS text, CASE WHEN a THEN s ELSE 1 END AS confidence, CASE WHEN a AND bad THEN whole ELSE 'grounded' END AS level,
            CASE WHEN a AND bad THEN 'GroundedAIHallucination: score ' || printf('%.2f', 1 - s) || ' (ML model)' WHEN a THEN 'GroundedAIHallucination: response appears well-grounded (ML model)' ELSE 'Backend unavailable — no analysis performed' END AS reason FROM w
        UNION ALL SELECT outcome_id, 2, '[Guardrails AI: BiasCheck detected potential bias in response]', 0.4, 'uncertain', 'Bias detected by ML classifier (Guardrails AI BiasCheck)' FROM w WHERE a AND k = 3
        UNION ALL SELECT outcome_id, 3, '[backend: ' || coalesce(e, 'validation failed') || ']', 0.3, 'hallucinated', 'backend flagged this response' FROM w WHERE a AND other
        UNION ALL SELECT outcome_id, 3, '[ToxicLanguage: validation failed]', 0.3, 'hallucinated', 'ToxicLanguage flagged this response' FROM w WHERE a AND k = 4),
    z AS (SELECT w.outcome_id, CASE WHEN a THEN w.s ELSE 1 END AS overall_score, CASE WHEN a THEN whole ELSE 'grounded' END AS overall_level, a AND (bad OR k = 3) AS has_hallucination, c.* EXCLUDE (outcome_id) FROM w JOIN (SELECT outcome_id,
            count(*) FILTER (level = 'grounded')::INT AS grounded, count(*) FILTER (level = 'uncertain')::INT AS uncertain, count(*) FILTER (level = 'hallucinated')::INT AS hallucinated,
            string_agg({O.case("level", present.LEVEL_ICON)} || ' **' || {_pct("confidence")} || '** — ' || {_preview("text")} || chr(10) || CASE WHEN level <> 'grounded' THEN '  - ⚠️ *' || reason || '*' || chr(10) ELSE '' END, '' ORDER BY n) AS lines FROM y GROUP BY 1) c USING (outcome_id))"""


@query(f"WITH {_SAID} SELECT * EXCLUDE (lines) FROM z")
def grounding_models(spark: SparkSession, sf: str) -> DataFrame:
    """Grounding by named validators: scores stated and assumed, bias, and other failures."""
    return _answered(spark, sf).select("outcome_id", "g.overall_score", "g.overall_level", "g.has_hallucination", "g.counts.*")


@query(
    f"""WITH {_SAID} SELECT outcome_id, '### 🧠 Hallucination Analysis' || chr(10) || chr(10) || '**Overall Confidence:** ' || {O.case("overall_level", present.LEVEL_ICON)} || ' **' || {_pct("overall_score")} || '** (' || {O.case("overall_level", present.LEVEL_LABEL)} || ')' || chr(10) || chr(10)
    || '`' || {_pct("overall_score")} || '` ' || repeat(CASE WHEN overall_score >= 0.7 THEN '🟩' WHEN overall_score >= 0.4 THEN '🟨' ELSE '🟥' END, floor(overall_score * 20 + 0.5)::INT) || repeat('⬜', (20 - floor(overall_score * 20 + 0.5))::INT) || chr(10) || chr(10)
    || CASE WHEN has_hallucination THEN '🟢 ' || grounded || ' grounded · 🟡 ' || uncertain || ' uncertain · 🔴 ' || hallucinated || ' hallucinated' || chr(10) || chr(10) || lines ELSE '*All statements appear well-grounded.* ✅' || chr(10) || chr(10) END AS report FROM z"""
)
def grounding_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence-by-sentence reports as markdown."""
    return _answered(spark, sf).select("outcome_id", present.grounding_report(F.col("g")).alias("report"))


_LABEL = O.case("k", R.SHORT_LABELS, "replace(lower(k), '_', ' ')")
_ICON = O.case("severity", present.SEVERITY_ICON, "'⚪'")
_CH = "(SELECT id, x.type AS k, x.severity AS severity, x.position AS position, x.replacement AS replacement, substring(text, (x.position + 1)::INT, x.length::INT) AS v FROM (SELECT id, text, unnest(ch) AS x FROM q))"


@query(
    O.chain("overlay", f"""SELECT r.id, CASE WHEN r.action = 'SANITIZE' THEN '## ⚠️ Prompt Modified for Safety' || chr(10) || chr(10) || {_risk_bar_sql("round(r.final_score, 6)")} || chr(10) || chr(10)
        || CASE WHEN d.lines IS NULL THEN '' ELSE '### 🔍 Detected & Redacted' || chr(10) || chr(10) || d.lines END || '---' || chr(10) || chr(10) END AS header,
        CASE WHEN r.action = 'ALLOW' THEN chr(10) || chr(10) || '---' || chr(10) || '*✅ Verified*' || chr(10) ELSE chr(10) || chr(10) || '---' || chr(10) || '*⚠️ Prompt was sanitized before sending to AI*' || chr(10) END AS footer
        FROM r LEFT JOIN (SELECT id, string_agg({_ICON} || ' **' || {_LABEL} || '** detected' || chr(10) || chr(10) || '> 🔴 ~~`' || {_mask_sql()} || '`~~ → 🟢 `' || replacement || '`' || chr(10) || chr(10), '' ORDER BY position DESC) AS lines FROM {_CH} GROUP BY id) d USING (id)""",
        O.findings(), O.scores(), O.kept(), O.changed())
)
def sanitize_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Header and footer of every text as markdown; a text that passed has no header.

    Not by a filter on the decision: the optimiser would push it below the scan's projections and work out
    the decision, with all it needs, twice.
    """
    s = scan(source(spark, sf, "overlay"))
    header = F.when(F.col("action") == "SANITIZE", present.sanitize_header(F.round("risk.final_score", 6), F.col("changes")))
    return s.select("id", header.alias("header"), present.footer(F.col("action")).alias("footer"))


@query(
    O.chain("overlay", f"""SELECT r.id, '## 🔍 Scan Report' || chr(10) || chr(10) || {_risk_bar_sql("round(r.final_score, 6)")} || chr(10) || chr(10) || '**Decision:** Would **' || r.action || '**' || chr(10) || chr(10)
        || coalesce('### Detected Items' || chr(10) || chr(10) || g.lines, '*No security risks detected.* ✅' || chr(10) || chr(10)) || coalesce('### Redactions Applied' || chr(10) || chr(10) || d.lines || chr(10), '') || '*Scan completed in 0ms*' || chr(10) AS report
        FROM r LEFT JOIN (SELECT id, string_agg(part, '' ORDER BY first) AS lines FROM (SELECT id, min(ord) AS first, '#### ' || {O.case("validator", present.CATEGORY_ICON)} || ' ' || {O.case("validator", present.CATEGORY_LABEL)} || chr(10) || chr(10) || '| | Type | Detected Value | Severity | Confidence |' || chr(10)
            || '|---|------|---------------|----------|------------|' || chr(10) || string_agg('| ' || {_ICON} || ' | ' || {_LABEL} || ' | `' || {_mask_sql()} || '` | ' || upper(severity) || ' | ' || {_pct("confidence")} || ' |' || chr(10), '' ORDER BY ord) || chr(10) AS part
            FROM (SELECT *, match AS v, type AS k FROM f) GROUP BY id, validator) GROUP BY id) g USING (id)
        LEFT JOIN (SELECT id, string_agg('- 🔴 ~~`' || {_mask_sql()} || '`~~ → 🟢 `' || replacement || '`  *(' || {_LABEL} || ')*' || chr(10), '' ORDER BY position DESC) AS lines FROM {_CH} GROUP BY id) d USING (id)""",
        O.findings(), O.scores(), O.kept(), O.changed())
)
def scan_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the dry run as markdown."""
    s = scan(source(spark, sf, "overlay"))
    return s.select("id", present.scan_report(F.round("risk.final_score", 6), F.col("action"), F.col("findings"), F.col("changes"), F.lit(0)).alias("report"))


@query(f"SELECT 'State: local-only' || chr(10) || 'Threshold: 0.3' || chr(10) || 'Total: ' || count(*) || ', allowed: ' || count(*) FILTER ({_NORM} = 'allow') || ', sanitized: ' || count(*) FILTER ({_NORM} = 'sanitize') || chr(10) AS status FROM audit_entries")
def status_report(spark: SparkSession, sf: str) -> DataFrame:
    """State, settings and counts in one text."""
    n = audit.stats(table(spark, sf, "audit_entries"))
    settings = Settings()
    return n.select(present.status_report(status_state(settings, False), [f"Threshold: {settings.sanitize_threshold}"], F.col("total"), F.col("allowed"), F.col("sanitized")).alias("status"))


# ----------------------------------------------------------------------------------- against recorded rows
@query(
    O.chain("requests", """SELECT coalesce(d.type, w.finding_type) AS type, count(*) FILTER (d.id IS NOT NULL AND w.id IS NOT NULL) AS both, count(*) FILTER (w.id IS NULL) AS ours_only, count(*) FILTER (d.id IS NULL) AS recorded_only
    FROM (SELECT DISTINCT id, type FROM f) d FULL JOIN (SELECT DISTINCT request_id AS id, finding_type FROM findings WHERE finding_type IS NOT NULL) w ON d.id = w.id AND d.type = w.finding_type GROUP BY 1""", O.findings(("pii", "secrets")))
)
def detector_vs_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """Types our detectors find in requests against the types recorded for them."""
    f = with_findings(source(spark, sf, "requests"), "text", Settings(enabled_validators=("pii", "secrets")))
    d = f.select("id", F.explode_outer(F.array_distinct(F.transform("findings", lambda x: x["type"]))).alias("type")).where("type is not null").withColumn("ours", F.lit(True))
    w = table(spark, sf, "findings").where(F.col("finding_type").isNotNull()).select(F.col("request_id").alias("id"), F.col("finding_type").alias("type")).distinct().withColumn("theirs", F.lit(True))
    j = d.join(w, ["id", "type"], "full")
    a, b = F.col("ours").isNotNull(), F.col("theirs").isNotNull()
    return j.groupBy("type").agg(F.count_if(a & b).alias("both"), F.count_if(~b).alias("ours_only"), F.count_if(~a).alias("recorded_only"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["Column", "oracle_sql", "queries"]
