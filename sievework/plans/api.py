"""The engine's front: scan, guard and status over DataFrames, batch or streaming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import backend, decide, detect, registry, remote, sanitize, score
from sievework.operators import rules as R


@dataclass(frozen=True)
class Settings:
    """What can be set, with its defaults."""

    enabled: bool = True
    backend_url: str = "http://localhost:8000"
    backend_enabled: bool = False
    backend_timeout_ms: int = 2000
    sanitize_threshold: float = decide.THRESHOLD
    enabled_validators: tuple[str, ...] | None = None
    custom_blocklist: tuple[str, ...] = ()
    audit_log_enabled: bool = True
    weights: Mapping[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, prefix: str = "spark.sievework.") -> Settings:
        """Settings from the session's configuration; what isn't set keeps its default."""
        get = lambda k: spark.conf.get(prefix + k, None)
        names = get("enabledValidators")
        words = get("customBlocklist")
        return cls(
            enabled=(get("enabled") or "true").lower() == "true",
            backend_url=get("backendUrl") or cls.backend_url,
            backend_enabled=(get("backendEnabled") or "false").lower() == "true",
            backend_timeout_ms=int(get("backendTimeout") or cls.backend_timeout_ms),
            sanitize_threshold=float(get("sanitizeThreshold") or cls.sanitize_threshold),
            enabled_validators=tuple(x.strip() for x in names.split(",") if x.strip()) if names is not None else None,
            custom_blocklist=tuple(words.split("\n")) if words else (),
            audit_log_enabled=(get("auditLogEnabled") or "true").lower() == "true",
        )


#: helper columns, of names that tables hardly have
TEXT, LOWER, RUN = "__sievework_text", "__sievework_lower", "__sievework_run"
_BUILT: dict[tuple, Column] = {}


def _built(df: DataFrame, key: tuple, make) -> Column:
    """A large expression over fixed column names, made once per application; making it takes many calls to the JVM."""
    key = (df.sparkSession.sparkContext.applicationId, registry.version(), *key)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def _detector(v: str, custom: tuple[str, ...]) -> Column:
    if v in registry.VALIDATORS:
        return registry.found_by(v, F.col(TEXT), F.col(LOWER))
    more = (custom,) if v == "toxicity" else (F.col(RUN),) if v in detect.RUN_USERS else ()
    return detect.DETECTORS[v](F.col(TEXT), F.col(LOWER), *more)


def with_findings(df: DataFrame, text: str, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``df`` with ``f_<validator>`` arrays of the enabled validators, and ``findings``, all of them in order.

    Disabled validators aren't planned at all.
    """
    names = validators(settings.enabled_validators)
    # in projections of their own: the detectors read them many times
    low = df.withColumn(TEXT, F.coalesce(F.col(text), F.lit(""))).withColumns({LOWER: F.lower(TEXT), RUN: detect.long_run(F.col(TEXT))})
    custom = tuple(settings.custom_blocklist)
    out = low.withColumns({f"f_{v}": _built(df, ("detect", v, custom), partial(_detector, v, custom)) for v in names}).drop(LOWER, RUN) if names else low.drop(LOWER, RUN)
    return out.withColumn("findings", F.concat(*[F.col(f"f_{v}") for v in names]) if names else detect.none())


def judged(found: DataFrame, settings: Settings = Settings(), failed: str | None = None) -> DataFrame:  # noqa: B008
    """Adds scores, risk, sanitized text, changes, decision and reason to the output of ``with_findings``.

    ``failed``: a boolean column, true where a remote guard flagged the text; it adds one finding over the
    whole text and a validator of its own.
    """
    names = validators(settings.enabled_validators)
    steps: dict[str, Column] = {f"s_{v}": _built(found, ("score", v), partial(_score, v)) for v in names}
    scores = {v: F.col(f"s_{v}") for v in names}
    present = None
    if failed is not None:
        flag = F.coalesce(F.col(failed), F.lit(False))
        steps["findings"] = F.when(flag, F.array_append("findings", backend.flag(F.col(TEXT)))).otherwise(F.col("findings"))
        scores["backend"], present = F.lit(backend.FLAG_SCORE), {"backend": flag}
    out = found.withColumns(steps) if steps else found
    text, findings = F.col(TEXT), F.col("findings")
    out = out.withColumns({"risk": score.risk(scores, findings, {**{v.name: v.weight for v in registry.VALIDATORS.values()}, **settings.weights}, present), "kept": _built(found, ("kept",), lambda: sanitize.deduplicated(findings))})
    out = out.withColumns(
        {"changes": _built(found, ("changes",), lambda: sanitize.changes(text, F.col("kept"))), "action": decide.action(findings, F.col("risk.final_score"), settings.sanitize_threshold)}
    )
    out = out.withColumns(
        {"sanitized": _built(found, ("sanitized",), lambda: sanitize.sanitized(text, findings, F.col("changes"))), "reason": _built(found, ("reason",), lambda: decide.reason(F.col("action"), F.col("changes"), F.col("risk.critical")))}
    )
    return out.withColumn("can_sanitize", _built(found, ("can",), lambda: sanitize.can_sanitize(findings, F.col("kept"), F.col("sanitized"))))


def _score(v: str) -> Column:
    return (registry.VALIDATORS[v].score if v in registry.VALIDATORS else score.SCORES[v])(F.col(f"f_{v}"))


def scan(df: DataFrame, text: str = "text", settings: Settings = Settings(), failed: str | None = None) -> DataFrame:  # noqa: B008
    """The dry run: every row of ``df`` with findings, scores, risk, changes, sanitized text and decision.

    One narrow stage: no shuffle, no Python worker. A null text is scanned as an empty one. Columns of
    ``df`` with the name of an output are replaced. Filter rows before the scan; to filter on its outputs,
    write or persist it first, else the optimiser pushes the filter down and detects twice.
    """
    return judged(with_findings(df, text, settings), settings, failed)


def guard(df: DataFrame, text: str = "text", settings: Settings = Settings(), verdicts: DataFrame | None = None, key: str | None = None, transport: remote.Transport = remote.http) -> DataFrame:  # noqa: B008
    """Scan with the remote guard's verdicts merged in; with ``settings.enabled`` false, rows pass through.

    ``verdicts``: (key, available, passed), at most one row per key. Missing or unavailable verdicts count
    as passed. Without verdicts but with ``settings.backend_enabled`` and a ``key``, the guard at
    ``settings.backend_url`` is asked.
    """
    if not settings.enabled:
        return df
    if verdicts is None and settings.backend_enabled and key is not None:
        verdicts = remote.verdicts(df, key, text, partial(remote.Guard, settings.backend_url, settings.backend_timeout_ms, transport=transport))
    if verdicts is None:
        return scan(df, text, settings)
    return scan(backend.merged(df, verdicts, key), text, settings, failed="backend_failed")


def report_columns(scanned: DataFrame, *keys: str) -> DataFrame:
    """A flat view of a scan: counts, risk, decision and text, without the arrays."""
    return scanned.select(*keys, F.size("findings").alias("n_findings"), F.round("risk.final_score", 6).alias("risk_score"), F.col("risk.dominant").alias("dominant"), F.col("risk.critical").alias("critical"), "action", "sanitized", "can_sanitize")


def status_state(settings: Settings, backend_available: bool) -> str:
    """off, local-only or active."""
    return "off" if not settings.enabled else "active" if settings.backend_enabled and backend_available else "local-only"


def validators(names: Sequence[str] | None = None) -> list[str]:
    """Names of the validators that run: the built-in ones, then those registered, as far as ``names`` has them."""
    return score.enabled(names, (*R.VALIDATORS, *registry.VALIDATORS))
