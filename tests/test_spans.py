import random
import re

import pytest
from pyspark.sql import functions as F

from sievework.functions.dialect import java, loose, re2
from sievework.functions.spans import spans
from sievework.operators import rules as R
from sievework.plans.overlay import PHRASES

ALL = [(v, i, r) for v, rules in R.RULES.items() for i, r in enumerate(rules)]


def _python(pattern: str, ignore: bool) -> re.Pattern:
    p = re.sub(r"\\x\{([0-9a-f]{4})\}", r"\\u\1", re2(pattern))
    return re.compile(p, re.ASCII | (re.IGNORECASE if ignore else 0))


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(1)
    rows = []
    for i, p in enumerate(PHRASES):
        q = r.choice(PHRASES)
        rows += [(3 * i, p), (3 * i + 1, f"é{p}\n{q} ñ"), (3 * i + 2, f"{p.upper()}   {q}_{p}")]
    rows += [(1000, ""), (1001, "😀 10.0.0.1 😀"), (1002, "x" * 50_000)]
    return rows, spark.createDataFrame(rows, "id int, t string").cache()


@pytest.mark.parametrize("rule", ALL, ids=[f"{v}-{i}" for v, i, _ in ALL])
def test_offsets_equal_python(texts, rule):
    rows, df = texts
    r = rule[2]
    got = {x["id"]: [(s["position"], s["length"], s["text"]) for s in x["s"]] for x in df.select("id", spans(F.col("t"), java(r.pattern, r.ignore_case), loose=loose(r.pattern, r.ignore_case)).alias("s")).collect()}
    p = _python(r.pattern, r.ignore_case)
    fired = 0
    for i, t in rows:
        want = [(m.start(), len(m[0]), m[0]) for m in p.finditer(t)]
        assert got[i] == want, (i, t)
        fired += len(want)
        # hints never keep a match away
        low = t.lower()
        if want:
            assert all(not g or any(h in low for h in g) for g in (r.hints, r.also)), (i, t)
    assert fired or r.type in ("AZURE_KEY", "GITLAB_TOKEN", "TWILIO_KEY", "SENDGRID_KEY", "GOOGLE_API_KEY", "HEROKU_KEY", "NPM_TOKEN", "JWT", "AWS_SECRET_KEY")


def test_sentinel_in_text_and_null(spark):
    df = spark.createDataFrame([("a\ue0001",), (None,), ("",)], "t string")
    assert [[tuple(s) for s in r[0]] for r in df.select(spans(F.col("t"), "[0-9]")).collect()] == [[(2, 1, "1")], [], []]


def test_zero_width_after_characters_beyond_the_basic_plane(spark):
    from sievework.operators import detect

    df = spark.createDataFrame([("🙂🙂he\u200bllo\u200b",), ("\u200bx",), ("x\u200b",), ("plain 🙂",), (None,)], "t string")
    got = [[f["position"] for f in r[0] or []] for r in df.select(detect.zero_width(F.col("t"))).collect()]
    assert got == [[4], [0], [1], [], []]
