"""The same scan over streams: the functions are those of the batch, so results are too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.operators import audit
from sievework.plans.api import Settings, scan


def scan_to_audit(texts: DataFrame, text: str, at: str, path: str, checkpoint: str, settings: Settings | None = None) -> StreamingQuery:
    """Scan a stream of texts and append hashed entries as JSON lines, all that is there, then stop.

    Settings are read from the session for every batch, so a changed blocklist holds from the next batch.
    """

    def write(batch: DataFrame, _: int) -> None:
        now = settings or Settings.of(batch.sparkSession)
        if now.enabled and now.audit_log_enabled:
            audit.append(audit.entries(scan(batch, text, now), text, F.col(at)), path)

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the entries that are added to a folder."""
    return spark.readStream.schema(audit.ENTRY).json(path)


def windowed(entries: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts of decisions per window of event time; entries later than ``late`` are left out by the watermark."""
    at = F.expr("try_to_timestamp(timestamp)")
    return entries.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", length).alias("w"), "decision").agg(F.count("*").alias("n")).select("w.start", "w.end", "decision", "n")
