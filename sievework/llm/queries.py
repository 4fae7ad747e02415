"""Registered queries of this package, and their DuckDB equivalents where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import abuse, credentials, lookalike, mixing, packing, percentiles, personal, quality, tokens
from sievework.sources.shared import settle
from sievework.sources.tables import spread, table

INF = float("inf")


def texts(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of texts, over all cores even where the table is one file."""
    return spread(table(spark, sf, name).select(*columns))


# ------------------------------------------------------------------------------------------ 1 percentiles
def _decision():
    """Spellings of a decision brought together."""
    d = F.lower(F.trim("decision"))
    return F.when(d == "ok", "allow").when(d == "masked", "sanitize").otherwise(d)


def _at():
    """When an entry was made, or where that isn't stated, when it arrived."""
    return F.coalesce(F.expr("try_to_timestamp(entry_ts)"), F.col("received_at"))


#: a latency is at least 0; a score lies between 0 and 1
METRICS = {"latency_ms": (F.col, 0.0, INF), "risk_score": (F.col, 0.0, 1.0)}
#: groupings of the entries, and what each keeps of the finest groups
GROUPINGS = {"all": (), "decision": ("decision",), "decision_day": ("decision", "day"), "decision_hour": ("decision", "day", "hour"), "decision_backend": ("decision", "backend_used")}


def _metrics():
    return {k: (make(k), lo, hi) for k, (make, lo, hi) in METRICS.items()}


def _groups():
    return {"decision": _decision(), "day": F.to_date(_at()), "hour": F.hour(_at()), "backend_used": F.col("backend_used")}


def p1_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of latency and score per decision, also per day, hour of a day, use of the backend and type of finding, and over all entries.

    Each row states its certified rank error. An entry counts once for each type among its findings; one
    without findings has a null type.
    """
    entries = table(spark, sf, "audit_entries")
    a = percentiles.certified(entries, _groups(), _metrics(), GROUPINGS).withColumn("finding_type", F.lit(None).cast("string"))
    types = F.array_distinct(F.transform("findings", lambda f: f["finding_type"]))
    each = entries.select("decision", "latency_ms", "risk_score", F.explode_outer(types).alias("finding_type"))
    b = percentiles.certified(each, {"decision": _decision(), "finding_type": "finding_type"}, _metrics(), {"decision_type": ("decision", "finding_type")})
    return a.unionByName(b, allowMissingColumns=True)


def p1_by_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per decision, certified."""
    return percentiles.certified(table(spark, sf, "audit_entries"), {"decision": _decision()}, _metrics()).drop("grouping")


def p1_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per decision from the digests of days, combined afterwards."""
    days = percentiles.digests(table(spark, sf, "audit_entries"), {"decision": _decision(), "day": F.to_date(_at())}, _metrics())
    e = percentiles.estimates(days, ["g_decision", "metric"])
    qs = F.array(*[F.lit(q) for q in percentiles.QUANTILES])
    return e.select(F.col("g_decision").alias("decision"), "metric", "n", "n_invalid", F.explode(F.arrays_zip(qs.alias("q"), F.col("est").alias("value"))).alias("x")).select("decision", "metric", "x.q", "x.value", "n", "n_invalid")


def p1_within_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Per group of every grouping, and metric: valid and invalid values, and whether every percentile lies within 1 % of its rank."""
    c = p1_percentiles(spark, sf)
    by = ["grouping", "decision", "day", "hour", "backend_used", "finding_type", "metric"]
    return c.groupBy(*by).agg(F.first("n").alias("n"), F.first("n_invalid").alias("n_invalid"), F.coalesce(F.max("rank_error") <= 0.01, F.lit(True)).alias("within_bound"))


# ------------------------------------------------------------------------------------------ 2 credentials
_MATCHES = ("finding_id", "request_id", "match_text", "match_position", "match_length")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines on which a credential begins, in requests and in findings.

    A finding in the form of a digest is one only if its request has a credential at its place.
    """
    spans = settle(credentials.spans_of(texts(spark, sf, "validate_requests", "request_id", "llm_output"), "request_id", "llm_output"))
    matches = texts(spark, sf, "findings", *_MATCHES)
    f = credentials.credential_lines(matches, "finding_id", "match_text", alone=True)
    named = credentials.named_in_text(matches, spans).withColumn("line_no", F.lit(1))
    one = lambda d, t: d.select(F.lit(t).alias("src_table"), "rec_id", "line_no")
    return one(credentials.lines(spans), "validate_requests").unionByName(one(f, "findings")).unionByName(one(named, "findings"))


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every request and every match of a finding with its credentials replaced by placeholders."""
    requests = texts(spark, sf, "validate_requests", "request_id", "llm_output")
    done = settle(requests.select(F.col("request_id").alias("rec_id"), credentials.redacted_with_spans()(F.col("llm_output")).alias("x")).select("rec_id", "x.*"))
    matches = texts(spark, sf, "findings", *_MATCHES)
    f = matches.select(F.col("finding_id").alias("rec_id"), credentials.redacted(alone=True)(F.col("match_text")).alias("redacted"))
    named = credentials.named_in_text(matches, done).withColumn("named", F.lit(True))
    f = f.join(named, "rec_id", "left").select("rec_id", F.when(F.col("named"), F.lit("[REDACTED-SECRET]")).otherwise(F.col("redacted")).alias("redacted"))
    one = lambda d, t: d.select(F.lit(t).alias("src_table"), "rec_id", "redacted")
    return one(done, "validate_requests").unionByName(one(f, "findings"))


# ------------------------------------------------------------------------------------------------ 3 abuse
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Texts whose author abuses, threatens, dehumanises or sexualises."""
    def over(name: str, key: str, column: str) -> DataFrame:
        t = texts(spark, sf, name, key, column).where(F.col(column).isNotNull())
        return t.select(F.lit(name).alias("src_table"), F.col(key).alias("rec_id"), abuse.abuse_score()(F.col(column)).alias("p")).where(F.col("p") >= abuse.THRESHOLD).drop("p")

    return over("validate_requests", "request_id", "llm_output").unionByName(over("validation_outcomes", "outcome_id", "raw_llm_output"))


def p3_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The score of every request and every outcome."""
    a = abuse.scored(texts(spark, sf, "validate_requests", "request_id", "channel", "llm_output"), "llm_output").select(F.lit("validate_requests").alias("src_table"), F.col("request_id").alias("rec_id"), "channel", "abuse_score")
    b = abuse.scored(texts(spark, sf, "validation_outcomes", "outcome_id", "channel", "raw_llm_output"), "raw_llm_output").select(F.lit("validation_outcomes").alias("src_table"), F.col("outcome_id").alias("rec_id"), "channel", "abuse_score")
    return a.unionByName(b)


def p3_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of abusive texts per table, of requests and of outcomes, and channel."""
    a = texts(spark, sf, "validate_requests", "channel", "llm_output").select(F.lit("validate_requests").alias("src_table"), "channel", F.col("llm_output").alias("text"))
    b = texts(spark, sf, "validation_outcomes", "channel", "raw_llm_output").select(F.lit("validation_outcomes").alias("src_table"), "channel", F.col("raw_llm_output").alias("text"))
    return abuse.rates(a.unionByName(b), "text", "channel", also=("src_table",))


# ------------------------------------------------------------------------------------------- 4 look-alikes
def _requests_and_messages(spark: SparkSession, sf: str) -> DataFrame:
    """(src_table, rec_id, text) of both tables."""
    one = lambda t, key, column: texts(spark, sf, t, key, column).select(F.lit(t).alias("src_table"), F.col(key).alias("rec_id"), F.col(column).alias("text"))
    return one("validate_requests", "request_id", "llm_output").unionByName(one("backend_messages", "message_id", "content"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of texts of one table that look the same but aren't the same string."""
    return lookalike.pairs(_requests_and_messages(spark, sf), "rec_id", "text", ("src_table",))


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per request and per message with a text: the class of texts of its table that look like it."""
    return lookalike.classes(_requests_and_messages(spark, sf), "rec_id", "text", ("src_table",))


def p4_normal(spark: SparkSession, sf: str) -> DataFrame:
    """Every request and every message in the form for comparison."""
    return lookalike.normalised(_requests_and_messages(spark, sf), "text").select("src_table", "rec_id", "normal_text")


# ---------------------------------------------------------------------------------------- 5 personal data
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines on which a piece of personal data begins, once per type."""
    r = personal.personal_lines(texts(spark, sf, "validate_requests", "request_id", "llm_output"), "request_id", "llm_output")
    c = personal.personal_lines(texts(spark, sf, "sanitize_changes", "change_id", "original_text"), "change_id", "original_text", alone=True)
    one = lambda d, t: d.select(F.lit(t).alias("src_table"), "rec_id", "line_no", "pii_type")
    return one(r, "validate_requests").unionByName(one(c, "sanitize_changes"))


def p5_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every request and every original text of a change with typed placeholders for its personal data."""
    r = texts(spark, sf, "validate_requests", "request_id", "llm_output").select(F.lit("validate_requests").alias("src_table"), F.col("request_id").alias("rec_id"), personal.redacted()(F.col("llm_output")).alias("redacted"))
    c = texts(spark, sf, "sanitize_changes", "change_id", "original_text").select(F.lit("sanitize_changes").alias("src_table"), F.col("change_id").alias("rec_id"), personal.redacted(alone=True)(F.col("original_text")).alias("redacted"))
    return r.unionByName(c)


# ---------------------------------------------------------------------------------------------- 6 packing
def _capacities(spark: SparkSession, sf: str) -> list[int]:
    return sorted({r[0] for r in table(spark, sf, "pack_limits").select("capacity_tokens").collect()})  # a table of settings


def p6_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, or piece of one larger than the capacity, with its container, for each capacity."""
    return packing.packed(tokens.sized(texts(spark, sf, "documents", "doc_id", "text"), "doc_id", "text"), _capacities(spark, sf))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Containers and share of space filled per capacity."""
    return packing.report(p6_packed(spark, sf))


# ----------------------------------------------------------------------------------------------- 7 mixing
def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each mix with their number of copies."""
    return mixing.mixed(tokens.sized(texts(spark, sf, "documents", "doc_id", "text", "source"), "doc_id", "text", "source"), table(spark, sf, "mix_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares reached by each source of each mix."""
    return mixing.shares(p7_mixture(spark, sf), table(spark, sf, "mix_targets"))


# ---------------------------------------------------------------------------------------------- 8 quality
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are a list, a table, junk or empty."""
    return quality.classified(texts(spark, sf, "documents", "doc_id", "text")).where("label <> 'prose'").select("doc_id")


def p8_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics and label of every document."""
    return quality.classified(texts(spark, sf, "documents", "doc_id", "text"))


def queries() -> dict:
    names = [
        p1_percentiles, p1_by_decision, p1_combined, p1_within_bound, p2_found, p2_redacted, p3_found, p3_scores, p3_rates, p4_found, p4_classes, p4_normal,
        p5_found, p5_redacted, p6_packed, p6_report, p7_mixture, p7_shares, p8_found, p8_statistics,
    ]
    return {f.__name__: f for f in names}


def _bounds_sql() -> str:
    norm = "CASE lower(trim(decision, ' ')) WHEN 'ok' THEN 'allow' WHEN 'masked' THEN 'sanitize' ELSE lower(trim(decision, ' ')) END"
    names, valid = ("decision", "day", "hour", "backend_used", "finding_type"), {"latency_ms": "l >= 0", "risk_score": "r >= 0 AND r <= 1"}
    parts = []
    for grouping, kept in {**GROUPINGS, "decision_type": ("decision", "finding_type")}.items():
        for metric, ok in valid.items():
            cols = ", ".join(n if n in kept else f"NULL::VARCHAR AS {n}" for n in names)
            by = f" GROUP BY {', '.join(kept)}" if kept else ""
            parts.append(f"SELECT '{grouping}' AS grouping, {cols}, '{metric}' AS metric, count(*) FILTER ({ok}) AS n, count(*) - count(*) FILTER ({ok}) AS n_invalid, true AS within_bound FROM {'t' if 'finding_type' in kept else 'e'}{by}")
    return f"""WITH a AS (SELECT entry_id, {norm} AS decision, coalesce(try_cast(entry_ts AS TIMESTAMPTZ), received_at::TIMESTAMPTZ) AT TIME ZONE 'UTC' AS ts, backend_used::VARCHAR AS backend_used, latency_ms::DOUBLE AS l, risk_score AS r, findings FROM audit_entries),
        e AS (SELECT decision, ts::DATE::VARCHAR AS day, hour(ts)::VARCHAR AS hour, backend_used, l, r FROM a),
        t AS (SELECT DISTINCT entry_id, decision, l, r, unnest(CASE WHEN len(findings) > 0 THEN list_transform(findings, lambda f: f.finding_type) ELSE [NULL::VARCHAR] END) AS finding_type FROM a)
        {' UNION ALL '.join(parts)}"""


def oracle_sql() -> dict[str, str]:
    return {"p1_within_bound": _bounds_sql()}
