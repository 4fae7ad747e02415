import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import audit
from sievework.plans.api import Settings, scan
from sievework.streaming import pipeline


@pytest.fixture()
def scanned(spark):
    df = spark.createDataFrame([(1, "my SSN is 123-45-6789"), (2, "hello"), (3, None)], "id int, text string")
    return scan(df).withColumn("at", F.lit("2026-01-02 03:04:05.678").cast("timestamp"))


def test_entries_hold_no_text(scanned):
    rows = audit.entries(scanned, "text", F.col("at")).collect()
    assert all("123-45" not in json.dumps(r.asDict(True)) for r in rows)
    assert {r["timestamp"] for r in rows} == {"2026-01-02T03:04:05.678Z"} and {len(r["promptHash"]) for r in rows} == {64}
    assert sorted(r["decision"] for r in rows) == ["allow", "allow", "sanitize"]


def test_files_round_trip_and_bad_lines(spark, scanned, tmp_path):
    path = str(tmp_path / "new" / "audit")
    e = audit.entries(scanned, "text", F.col("at"))
    audit.append(e, path)
    audit.append(e, path)
    assert audit.read(spark, path).count() == audit.read_all(spark, path).count() == 6
    assert audit.stats(audit.read(spark, path)).first().asDict() == {"total": 6, "allowed": 4, "sanitized": 2}
    (tmp_path / "new" / "audit" / "bad.json").write_text('{"timestamp": 1, oops\n')
    assert audit.read_all(spark, path).count() == 0
    lenient = audit.read(spark, path, strict=False).cache()
    assert lenient.where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception):  # noqa: B017, PT011
        audit.read(spark, path).collect()


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["my SSN is 123-45-6789", "hello", "foo bar"])], "id int, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withColumn("at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    spark.conf.set("spark.sievework.customBlocklist", "foo")
    try:
        pipeline.scan_to_audit(stream, "text", "at", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    finally:
        spark.conf.unset("spark.sievework.customBlocklist")
    batch = audit.entries(scan(df, "text", Settings(custom_blocklist=("foo",))), "text", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    key = lambda d: sorted((r["promptHash"], r["decision"], r["riskScore"], str(r["findings"])) for r in d.collect())
    assert key(audit.read(spark, str(tmp_path / "out"))) == key(batch)
    tail = pipeline.tail(spark, str(tmp_path / "out"))
    q = tail.writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(*) from tailed").first()[0] == 3


def test_windows(spark):
    e = spark.createDataFrame([("2026-01-01T00:10:00.000Z", "allow"), ("2026-01-01T00:50:00.000Z", "allow"), ("2026-01-01T01:10:00.000Z", "allow"), (None, "allow")], "timestamp string, decision string")
    assert sorted(r["n"] for r in pipeline.windowed(e).collect()) == [1, 2]


def test_settings(spark):
    assert Settings.of(spark) == Settings()
    spark.conf.set("spark.sievework.enabledValidators", "pii, jailbreak")
    spark.conf.set("spark.sievework.sanitizeThreshold", "0.5")
    try:
        got = Settings.of(spark)
    finally:
        spark.conf.unset("spark.sievework.enabledValidators")
        spark.conf.unset("spark.sievework.sanitizeThreshold")
    assert got.enabled_validators == ("pii", "jailbreak") and got.sanitize_threshold == 0.5
