import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import lookalike as L


def test_forms():
    assert L.look("ﬁle") == "file" and L.look("Ａ\u3000ｂ") == "A b" and L.look("é") == "é"
    assert L.look("а\u200bb") == "ab"  # Cyrillic a
    assert L.look("m²") == "m²" and L.comparison("m²") == "m2"
    assert L.look("Cafe") != L.look("cafe") and L.comparison("STRASSE") == L.comparison("straße")
    assert L.look("cafe") != L.look("café") and L.look("a\u00a0b") == "a b"
    assert L.look("") == "" and L.look("a\nb") == "a\nb"


@given(st.text(max_size=30))
@settings(max_examples=300, deadline=None)
def test_stable(s):
    for f in (L.look, L.comparison):
        once = f(s)
        assert f(once) == once


def _brute(rows):
    return {(a, b) for (a, x), (b, y) in itertools.combinations(sorted((i, t) for i, t in rows if t is not None), 2) if x != y and L.look(x) == L.look(y)}


ROWS = [(1, "file one"), (2, "ﬁle one"), (3, "file\u00a0one"), (4, "File one"), (5, None), (6, ""), (7, "file one"), (8, "m²"), (9, "m2"), (10, "x" * 60_000), (11, "x" * 60_000 + "\u200b"), (12, "")]


def test_pairs_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in ROWS], "k long, t string, id string")
    got = [tuple(r) for r in L.pairs(df, "k", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(ROWS)


@given(st.text(max_size=30))
@settings(max_examples=500, deadline=None)
def test_what_looks_the_same_compares_the_same(s):
    assert L.comparison(L.look(s)) == L.comparison(s)


@pytest.mark.parametrize("hot", [0, 1, L.HOT])
def test_large_classes_of_many_spellings(spark, monkeypatch, hot):
    monkeypatch.setattr(L, "HOT", hot)
    rows = [(i, f"{'file' if i % 3 else 'ﬁle'} {'one' if i % 5 else 'two'}") for i in range(60)] + [(100, "File one"), (101, "lone"), (102, None)]
    df = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in rows], "k long, t string, of string")
    got = [tuple(r) for r in L.pairs(df, "k", "t", most=50).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)
    got = [tuple(r) for r in L.pairs(df, "k", "t", ("of",), most=50).collect()]
    assert {(a, b) for _, a, b in got} == {(a, b) for a, b in _brute(rows) if a % 2 == b % 2} and len(got) == len(set(got))
    sizes = {r["k"]: (r["class_id"], r["class_rows"], r["spellings"]) for r in L.classes(df, "k", "t").collect()}
    assert len(sizes) == 62 and sizes[7] == (1, 48, 2) and sizes[100] == (100, 1, 1)


def test_classes(spark):
    df = spark.createDataFrame(ROWS, "k long, t string")
    got = {r["k"]: r for r in L.classes(df, "k", "t").collect()}
    assert set(got) == {i for i, t in ROWS if t is not None}
    assert got[7]["class_id"] == 1 and got[7]["class_rows"] == 4 and got[7]["spellings"] == 3
    assert got[12]["class_id"] == 6 and got[12]["spellings"] == 1


def test_column_keeps_nulls_and_replaces_clashing_names(spark):
    df = spark.createDataFrame([(1, "Ａ", "old"), (2, None, "old")], "k long, t string, normal_text string")
    assert [r["normal_text"] for r in L.normalised(df, "t").orderBy("k").collect()] == ["a", None]


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, t string")
    assert L.pairs(df, "k", "t").count() == 0 and L.classes(df, "k", "t").count() == 0
