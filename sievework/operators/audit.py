"""Audit entries: hashed, without raw text; their files, statistics and listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("promptHash", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("riskScore", T.DoubleType()),
        T.StructField("findings", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("type", "severity", "validator")]))),
        T.StructField("backendUsed", T.BooleanType()),
        T.StructField("latencyMs", T.LongType()),
    ]
)


def prompt_hash(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes, in hexadecimal."""
    return F.sha2(text, 256)


def iso(ts: Column) -> Column:
    """A timestamp as ISO 8601 in UTC with milliseconds; the session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def summary(findings: Column) -> Column:
    """Findings as an audit entry keeps them: no match, no offsets."""
    return F.transform(findings, lambda f: F.struct(f["type"].alias("type"), f["severity"].alias("severity"), f["validator"].alias("validator")))


def entries(scanned: DataFrame, text: str, at: Column, latency: Column | None = None, used: Column | None = None) -> DataFrame:
    """One entry per row of a scan, in the columns of the files."""
    return scanned.select(
        iso(at).alias("timestamp"), prompt_hash(F.coalesce(F.col(text), F.lit(""))).alias("promptHash"), F.lower("action").alias("decision"), F.col("risk.final_score").alias("riskScore"), summary(F.col("findings")).alias("findings"),
        (used if used is not None else F.lit(False)).alias("backendUsed"), (latency if latency is not None else F.lit(0)).cast("long").alias("latencyMs"),
    )


def append(df: DataFrame, path: str) -> None:
    """Entries as JSON lines added to a folder, which is made if it isn't there."""
    df.write.mode("append").json(path)


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Entries of a folder. Strict: one bad line fails the reading; else bad lines come in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(ENTRY).option("mode", "FAILFAST").json(path)
    return spark.read.schema(T.StructType([*ENTRY.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """All entries, or none at all if any line is malformed. The files are read twice: to count bad lines, and for the entries."""
    # every column is asked for, else nothing is parsed and no line is found to be bad
    broken = read(spark, path, strict=False).agg(F.count("_corrupt_record").alias("n"), F.max(F.xxhash64(*ENTRY.names))).first()["n"]
    return read(spark, path).limit(0) if broken else read(spark, path)


def stats(df: DataFrame, *groups: str) -> DataFrame:
    """Entries in all, allowed and sanitized."""
    d = F.lower(F.trim("decision"))
    return df.groupBy(*groups).agg(F.count("*").alias("total"), F.count_if(d == "allow").alias("allowed"), F.count_if(d == "sanitize").alias("sanitized"))


def finding_text(findings: Column, kind: str = "type") -> Column:
    """``type (severity)``, joined by commas; None without findings."""
    some = F.transform(findings, lambda f: F.concat(f[kind], F.lit(" ("), f["severity"], F.lit(")")))
    return F.when(F.size(findings) > 0, F.array_join(some, ", ")).otherwise(F.lit("None"))


def score_bar(score: Column) -> Column:
    """``struct<pct, color>`` of the score's bar."""
    return F.struct(F.floor(score * 100 + 0.5).cast("int").alias("pct"), F.when(score < 0.3, F.lit("#4a4")).when(score < 0.7, F.lit("#cc4")).otherwise(F.lit("#c44")).alias("color"))


def badge(decision: Column) -> Column:
    return F.concat(F.upper(F.left(decision, F.lit(1))), F.substring(decision, F.lit(2), F.length(decision)))


def log_line(ts: Column, level: Column, message: Column) -> Column:
    return F.format_string("[%s] [%s] %s", iso(ts), level, message)


LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")


def decision_message(decision: Column, score: Column, latency_ms: Column) -> Column:
    """What a log says of a decision."""
    return F.format_string("Decision: %s (score: %.2f, latency: %sms)", decision, score, latency_ms.cast("string"))


def backend_message(event: Column, details: Column) -> Column:
    """What a log says of the remote guard; without details only the event."""
    return F.concat(F.lit("Backend: "), event, F.when(F.length(details) > 0, F.concat(F.lit(" — "), details)).otherwise(F.lit("")))
