"""Own validators and replacements, and the remote guard without a network."""

import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import audit, detect, registry, remote
from sievework.plans.api import Settings, guard, scan, validators
from sievework.sources.ship import ship


@pytest.fixture
def own():
    def order_numbers(text, lower):
        from sievework.functions.spans import spans

        return F.transform(spans(text, r"ORD-[0-9]{4}"), lambda h: detect.finding("ORDER_NO", h["text"], h["position"], h["length"], 0.9, "low", "orders"))

    registry.register(registry.Validator("orders", order_numbers, weight=0.6, replacements={"ORDER_NO": "[ORDER]"}))
    yield
    registry.clear()


def test_own_validator_and_replacement(spark, own):
    df = spark.createDataFrame([(1, "see ORD-1234 now", "mine"), (2, "nothing", None), (3, None, "x")], "id long, text string, _text string")
    got = {r["id"]: r for r in scan(df).collect()}
    assert got[1]["sanitized"] == "see [ORDER] now" and got[1]["risk"]["dominant"] == "orders" and got[1]["action"] == "SANITIZE" and got[1]["_text"] == "mine"
    assert got[1]["risk"]["final_score"] == pytest.approx(0.28 * 0.6 / 5.0) and got[2]["action"] == got[3]["action"] == "ALLOW"
    assert validators() == ["pii", "secrets", "injection", "jailbreak", "toxicity", "orders"] and validators(["orders", "no"]) == ["orders"]
    assert scan(df, settings=Settings(enabled_validators=("pii",))).where("id = 1").first()["findings"] == []
    registry.register_replacement("ORDER_NO", lambda f: F.concat(F.lit("#"), F.right(f["match"], F.lit(2))))
    assert scan(df).where("id = 1").first()["sanitized"] == "see #34 now"
    registry.unregister("orders")
    assert scan(df).where("id = 1").first()["findings"] == []


def test_a_validator_that_fails_finds_nothing(spark):
    registry.register(registry.Validator("broken", lambda text, lower: 1 / 0))
    try:
        df = spark.createDataFrame([(1, "my SSN is 123-45-6789")], "id long, text string")
        assert [f["type"] for f in scan(df).first()["findings"]] == ["SSN"]
        with pytest.raises(ValueError, match="built in"):
            registry.register(registry.Validator("pii", lambda text, lower: detect.none()))
    finally:
        registry.clear()


class Answers:
    """A transport that gives what it is told, an exception or an answer."""

    def __init__(self, *answers):
        self.answers, self.calls = list(answers), []

    def __call__(self, url, body, timeout):
        self.calls.append((url, body, timeout))
        if body is None:
            return "{}"
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return json.dumps(a)


def test_retries_refusals_and_health():
    slept, now = [], [0.0]
    make = lambda t: remote.Guard("http://g/", 1500, "my guard", t, sleep=slept.append, clock=lambda: now[0])
    t = Answers(OSError("busy"), OSError("busy"), {"validation_passed": False, "call_id": "c", "error": "bad"})
    g = make(t)
    v = g.judge("x")
    assert (v["available"], v["passed"], v["call_id"], v["error"]) == (True, False, "c", "bad") and slept == [0.5, 1.0]
    assert t.calls[0][0] == "http://g/health" and t.calls[1] == ("http://g/guards/my%20guard/validate", '{"llmOutput": "x", "numReasks": 0}', 1.5)
    t = Answers(remote.Refused("HTTP 400"), {"validationPassed": True})
    g = make(t)
    assert g.judge("x")["passed"] and not g.available and len(t.calls) == 2
    assert not g.judge("y")["available"] and len(t.calls) == 2  # known to be down
    now[0] = 61.0
    assert g.judge("y")["available"]
    down = make(lambda url, body, timeout: (_ for _ in ()).throw(OSError("no route")))
    assert down.judge("x") == {"available": False, "passed": True, "validated": None, "error": None, "call_id": None, "latency_ms": 0}


def stand_in(url, body, timeout):
    return json.dumps({"validationPassed": "bad" not in json.loads(body)["llmOutput"]}) if body else "{}"


def test_guard_asks_the_backend(spark):
    ship(spark)
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df = spark.createDataFrame([(1, "bad words"), (2, "fine"), (3, None)], "id long, text string")
    on = Settings(backend_enabled=True)
    got = {r["id"]: r for r in guard(df, settings=on, key="id", transport=stand_in).collect()}
    assert got[1]["backend_failed"] and got[1]["action"] == "SANITIZE" and all(r["backend_used"] for r in got.values()) and got[3]["action"] == "ALLOW"
    assert "backend_used" not in guard(df, key="id").columns and guard(df, settings=Settings(enabled=False)) is df


def test_log_messages_and_all_or_nothing(spark, tmp_path):
    df = spark.createDataFrame([("ALLOW", 0.125, 7, "down", None), ("SANITIZE", 1.0, None, "up", "v2")], "d string, s double, l long, e string, x string")
    got = df.select(audit.decision_message(F.col("d"), F.col("s"), F.col("l")), audit.backend_message(F.col("e"), F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("Decision: ALLOW (score: 0.13, latency: 7ms)", "Backend: down"), ("Decision: SANITIZE (score: 1.00, latency: nullms)", "Backend: up — v2")]
    good = '{"timestamp":"2026-01-01T00:00:00.000Z","promptHash":"a","decision":"allow","riskScore":0.0,"findings":[],"backendUsed":false,"latencyMs":1}\n'
    (tmp_path / "a.json").write_text(good * 3)
    assert audit.read_all(spark, str(tmp_path)).count() == 3
    (tmp_path / "b.json").write_text(good + "{broken\n")
    assert audit.read_all(spark, str(tmp_path)).count() == 0
