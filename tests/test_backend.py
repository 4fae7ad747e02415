from pyspark.sql import functions as F

from sievework.operators import backend, output


def test_models_with_policies_retries_and_fail_open(spark):
    df = spark.createDataFrame([(1, "a@b"), (2, "kill"), (3, None), (4, "fine")], "id long, t string")

    def fix():
        return lambda ts: [("@" not in t, "x") for t in ts]

    def stop():
        state = {"calls": 0}

        def run(ts):
            state["calls"] += 1
            if state["calls"] == 1:
                raise RuntimeError("busy")
            return [("kill" not in t, None) for t in ts]

        return run

    def down():
        def run(ts):
            raise ValueError("400")

        return run

    got = {r["id"]: r for r in backend.guarded(df, "id", "t", [("P", "fix", fix), ("T", "exception", stop), ("D", "exception", down)], wait=0.0).collect()}
    assert got[1]["validated"] == "x" and got[1]["flagged"] == ["P"] and got[1]["passed"]
    assert not got[2]["passed"] and got[2]["error"] == "T failed" and got[2]["validated"] is None
    assert got[3]["passed"] and got[3]["validated"] == "" and got[4]["flagged"] == []


def test_answers_in_both_spellings(spark):
    rows = [('{"callId": "", "call_id": "x", "validation_passed": true, "rawLlmOutput": "r"}',), ('{"validationPassed": false, "error": "e"}',), ("not json",), (None,)]
    got = [r["p"].asDict() for r in spark.createDataFrame(rows, "j string").select(backend.parsed(F.col("j")).alias("p")).collect()]
    assert got[0] == {"call_id": "x", "raw": "r", "validated": None, "passed": True, "error": None}
    assert got[1]["error"] == "e" and not got[1]["passed"] and got[2]["call_id"] == "" and not got[3]["passed"]


def test_hallucination_scores(spark):
    kinds = backend.VALIDATIONS
    rows = [([("GroundedHallucination", False, None, {"score": 0.6})],), ([("hallucination", True, None, None)],), ([("hallucination", False, None, None)],), ([("backend", False, None, None)],), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, f"v {kinds}").select(backend.hallucination_score(F.col("v"))).collect()]
    assert got == [0.6, 0.1, 0.8, 0.0, 0.0]


def test_grounding_levels(spark):
    kinds = backend.VALIDATIONS
    rows = [("a" * 300, True, False, 0.7, [("Hallucination", False, None, None), ("BiasCheck", False, None, None), ("Toxic", False, "bad", None)]), ("ok", False, True, 0.0, []), ("ok", None, True, 0.0, []), ("ok", True, True, 0.0, [])]
    df = spark.createDataFrame(rows, f"t string, a boolean, p boolean, s double, v {kinds}")
    g = [r["g"] for r in df.select(output.grounding(*[F.col(c) for c in "tapsv"]).alias("g")).collect()]
    assert [s["level"] for s in g[0]["sentences"]] == ["hallucinated", "uncertain", "hallucinated"] and g[0]["counts"].asDict() == {"grounded": 0, "uncertain": 1, "hallucinated": 2}
    assert g[0]["has_hallucination"] and len(g[0]["sentences"][0]["text"]) == 203
    assert g[1]["sentences"][0]["text"] == output.UNAVAILABLE and not g[2]["has_hallucination"] and g[3]["overall_level"] == "grounded"


def test_response_chunks(spark):
    df = spark.createDataFrame([([(2, "b"), (1, "a"), (10, "c")],), ([],)], "c array<struct<seq:int,chunk:string>>")
    assert [r[0] for r in df.select(output.assembled(F.col("c"))).collect()] == ["abc", ""]
