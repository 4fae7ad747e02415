"""The whole queries over the smallest tables."""

import re

import pytest

from sievework.llm import queries as L
from sievework.sources.ship import ship

FOUND = {
    "p2_found": {"src_table": "string", "rec_id": "bigint", "line_no": "int"},
    "p3_found": {"src_table": "string", "rec_id": "bigint"},
    "p4_found": {"src_table": "string", "id_a": "bigint", "id_b": "bigint"},
    "p5_found": {"src_table": "string", "rec_id": "bigint", "line_no": "int", "pii_type": "string"},
    "p8_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(L.queries()))
def test_runs(spark, sf, name):
    ship(spark)
    df = L.queries()[name](spark, sf)
    rows = df.collect()
    assert rows
    if name in FOUND:
        assert dict(df.dtypes) == FOUND[name] and len(rows) == len(set(rows))


def test_names():
    assert all(re.fullmatch(r"p[1-8]_\w+", n) for n in L.queries()) and set(L.oracle_sql()) <= set(L.queries())


def test_rates_count_every_text_of_both_tables(spark, sf):
    ship(spark)
    got = {(r["src_table"], r["source"]): (r["texts"], r["flagged"]) for r in L.p3_rates(spark, sf).collect()}
    want = {}
    for t, c in (("validate_requests", "llm_output"), ("validation_outcomes", "raw_llm_output")):
        for r in spark.read.parquet(f"{sf}/{t}.parquet").where(f"{c} is not null").groupBy("channel").count().collect():
            want[t, r["channel"]] = r["count"]
    assert {k: n for k, (n, _) in got.items()} == want
    flagged = {r["src_table"]: r["count"] for r in L.p3_found(spark, sf).groupBy("src_table").count().collect()}
    for t in ("validate_requests", "validation_outcomes"):
        assert sum(f for (name, _), (_, f) in got.items() if name == t) == flagged.get(t, 0)


@pytest.mark.parametrize(
    "number,mark,tables",
    [
        (2, r"\[REDACTED-", [("validate_requests", "request_id", "llm_output"), ("findings", "finding_id", "match_text")]),
        (5, r"\[(?:EMAIL|PHONE|ID_NUMBER|ADDRESS|NAME)\]", [("validate_requests", "request_id", "llm_output"), ("sanitize_changes", "change_id", "original_text")]),
    ],
)
def test_redacted_covers_both_tables(spark, sf, number, mark, tables):
    ship(spark)
    got = {(r["src_table"], r["rec_id"]): r["redacted"] for r in L.queries()[f"p{number}_redacted"](spark, sf).collect()}
    raw = {(t, r[0]): r[1] for t, key, c in tables for r in spark.read.parquet(f"{sf}/{t}.parquet").select(key, c).collect()}
    assert got.keys() == raw.keys() and all((got[k] is None) == (raw[k] is None) for k in raw)
    found = {(r["src_table"], r["rec_id"]) for r in L.queries()[f"p{number}_found"](spark, sf).collect()}
    assert {t for t, _ in found} == {t for t, _, _ in tables}
    assert all(got[k] != raw[k] and re.search(mark, got[k]) for k in found)


def test_normal_forms_and_classes_cover_both_tables(spark, sf):
    ship(spark)
    tables = [("validate_requests", "request_id", "llm_output"), ("backend_messages", "message_id", "content")]
    raw = {(t, r[0]): r[1] for t, key, c in tables for r in spark.read.parquet(f"{sf}/{t}.parquet").select(key, c).collect()}
    normal = {(r["src_table"], r["rec_id"]): r["normal_text"] for r in L.p4_normal(spark, sf).collect()}
    assert normal.keys() == raw.keys() and all((normal[k] is None) == (raw[k] is None) for k in raw)
    classes = {(r["src_table"], r["rec_id"]): r["class_id"] for r in L.p4_classes(spark, sf).collect()}
    assert classes.keys() == {k for k, v in raw.items() if v is not None}
    pairs = L.p4_found(spark, sf).collect()
    assert {p["src_table"] for p in pairs} == {t for t, _, _ in tables}
    for p in pairs:
        a, b = (p["src_table"], p["id_a"]), (p["src_table"], p["id_b"])
        assert normal[a] == normal[b] and classes[a] == classes[b]
