import pytest

from sievework.plans.api import Settings, guard, scan
from tests.golden import ROWS


@pytest.fixture(scope="module")
def scanned(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(ROWS)], "id int, text string")
    # secrets have no rules of the golden rows' origin; an empty list of findings still counts in the mean
    return {r["id"]: r for r in scan(df).collect()}


@pytest.mark.parametrize("i", range(len(ROWS)))
def test_row(scanned, i):
    text, findings, scores, risk, action, clean, can = ROWS[i]
    row = scanned[i]
    got = [f"{f['type']}@{f['position']}+{f['length']}" for f in row["findings"] if f["validator"] != "secrets"]
    assert got == findings
    for v in ("pii", "injection", "jailbreak", "toxicity"):
        assert row[f"s_{v}"] == pytest.approx(scores.get(v, 0), abs=1e-6)
    if not row["f_secrets"]:
        assert row["risk"]["final_score"] == pytest.approx(risk, abs=1e-6)
    assert row["action"] == action
    assert row["sanitized"] == (text if clean is None else clean)
    assert row["can_sanitize"] == can


def test_backend_flag_covers_the_text(spark):
    texts = ["card 4111-1111-1111-1111", "email john@example.com card 4111-1111-1111-1111 ssn 123-45-6789", "hello"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    verdicts = spark.createDataFrame([(0, True, False), (1, True, False), (2, False, False)], "id int, available boolean, passed boolean")
    rows = {r["id"]: r for r in guard(df, "text", Settings(), verdicts, "id").collect()}
    assert rows[0]["sanitized"] == texts[0]
    assert rows[1]["sanitized"] == "email [REDACTED-EMAIL] card [REDACTED-CC] ssn [REDACTED-SSN]"
    assert rows[2]["action"] == "ALLOW" and not rows[2]["backend_used"]
    assert rows[0]["risk"]["breakdown"]["backend"] == 0.8 and "backend" not in rows[2]["risk"]["breakdown"]


def test_disabled_guard_passes_rows_through(spark):
    df = spark.createDataFrame([(1, "my SSN is 123-45-6789")], "id int, text string")
    assert guard(df, "text", Settings(enabled=False)).columns == ["id", "text"]


def test_disabled_validators_and_nulls_and_clashes(spark):
    df = spark.createDataFrame([(1, "my SSN is 123-45-6789", "x"), (2, None, "y")], "id int, text string, findings string")
    rows = {r["id"]: r for r in scan(df, "text", Settings(enabled_validators=("injection",))).collect()}
    assert rows[1]["findings"] == [] and rows[1]["action"] == "ALLOW" and rows[1]["risk"]["dominant"] == "injection"
    assert rows[2]["sanitized"] == "" and rows[2]["findings"] == []


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], "text string")).count() == 0


def test_custom_terms(spark):
    df = spark.createDataFrame([("Do not say FOO.bar here, nor foo",)], "text string")
    row = scan(df, "text", Settings(custom_blocklist=(" Foo.Bar ", ""), enabled_validators=("toxicity",))).first()
    assert [(f["type"], f["position"], f["length"], f["match"], f["confidence"]) for f in row["findings"]] == [("CUSTOM_BLOCKED", 11, 7, "fo***ar", 0.9)]
