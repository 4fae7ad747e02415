import random
import re

from pyspark.sql import functions as F

from sievework.operators import decide, sanitize, score
from sievework.operators.detect import FINDINGS


def _kept(findings):
    """The rule in plain words: by position, longer first; a later one wins an overlap only by confidence."""
    out, end = [], -1
    for f in sorted(findings, key=lambda f: (f[2], -f[3])):
        if f[2] >= end:
            out.append(f)
            end = f[2] + f[3]
        elif f[4] > out[-1][4]:
            out[-1] = f
            end = f[2] + f[3]
    return out


def test_overlaps_equal_plain_rule_and_never_remain(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        fs = [(r.choice(["EMAIL", "PHONE", "HARASSMENT"]), "m", r.randrange(20), r.randrange(1, 8), r.choice([0.5, 0.7, 0.9]), "low", "pii") for _ in range(r.randrange(7))]
        rows.append((i, fs))
    df = spark.createDataFrame(rows, f"id int, f {FINDINGS}")
    for row in df.select("id", sanitize.deduplicated(F.col("f")).alias("k")).collect():
        got = [tuple(x) for x in row["k"]]
        assert got == _kept(rows[row["id"]][1])


def _cleaned(t):
    t = re.sub(r"[ \t]{2,}", " ", t)
    t = re.sub(r"\n\s*\n\s*\n", "\n\n", t)
    t = re.sub(r"^\s+|\s+$", lambda m: "\n" if "\n" in m[0] else " ", t, flags=re.M)
    return t.strip()


def test_clean_up_equals_plain_rule(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("ab  \t\n\n") for _ in range(r.randrange(14))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for row in df.select("id", sanitize.cleaned(F.col("t")).alias("c")).collect():
        assert row["c"] == _cleaned(texts[row["id"]]), repr(texts[row["id"]])


def test_replacements_and_originals_rebuild_the_text(spark):
    text = "mail a.b@example.org or 10.0.0.1, ssn 123-45-6789"
    fs = [("EMAIL", "", 5, 15, 0.95, "medium", "pii"), ("IP_ADDRESS", "", 24, 8, 0.7, "low", "pii"), ("SSN", "", 38, 11, 0.95, "critical", "pii"), ("HARASSMENT", "", 0, 4, 0.8, "high", "toxicity")]
    df = spark.createDataFrame([(text, fs)], f"t string, f {FINDINGS}").withColumn("k", sanitize.deduplicated(F.col("f"))).withColumn("c", sanitize.changes(F.col("t"), F.col("k")))
    row = df.select("c", sanitize.replaced(F.col("t"), F.col("c")).alias("r")).first()
    assert [c["original_text"] for c in row["c"]] == ["123-45-6789", "10.0.0.1", "a.b@example.org"]
    back = row["r"]
    for c in row["c"]:
        back = back.replace(c["replacement"], c["original_text"])
    assert back == text


def test_labels_and_severities(spark):
    df = spark.createDataFrame([("SSN", "high"), ("SOME_NEW_TYPE", "odd"), (None, None)], "k string, s string")
    got = [tuple(r) for r in df.select(decide.label(F.col("k")), score.severity_rank(F.col("s"))).collect()]
    assert got == [("Social Security number", 2), ("some new type", None), (None, None)]


def test_risk_clamps_weights_and_counts_silent_validators(spark):
    df = spark.createDataFrame([(0.5, 0.0, [])], f"a double, b double, f {FINDINGS}")
    one = df.select(score.risk({"pii": F.col("a"), "new": F.col("b")}, F.col("f"), {"pii": 7.0}).alias("r")).first()["r"]
    assert one["final_score"] == 0.5 / 1.5 and one["dominant"] == "pii"
    none = df.select(score.risk({}, F.col("f")).alias("r")).first()["r"]
    assert none["final_score"] == 0 and none["dominant"] == "none"
    tie = df.select(score.risk({"secrets": F.lit(0.0), "pii": F.lit(0.0)}, F.col("f")).alias("r")).first()["r"]
    assert tie["dominant"] == "secrets"
