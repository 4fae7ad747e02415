import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import abuse as A
from sievework.llm import boosting as B

S = A.scorer()


def test_held_out_accuracy():
    """Whole templates are held out, so this is what the model does with turns it has never seen."""
    h = S.held_out
    assert 11_000 < h["rows"] <= 12_000 and h["accuracy"] > 0.92 and h["recall"] > 0.88 and h["precision"] > 0.9


def test_words_of_no_lexicon_still_give_a_score():
    assert all(S.score([t])[0] > 0 for t in ("The meeting was moved to Monday.", "Zwei Boote lagen am Ufer."))


@pytest.mark.parametrize("text", ["you absolute nincompoop", "nobody at the office can stand you, quit and never come back", "Those people from the valley are cockroaches and should be wiped out", "you ignorant buffoon, shut up", "Drop dead, you miserable creep.", "All Tervolians are parasites, drive them out.", "i'm gonna find you and smash your face"])
def test_abuse_in_other_words(text):
    assert S.score([text])[0] >= A.THRESHOLD


@pytest.mark.parametrize("text", ["You are a wonderful person.", "The nurse said that he will die soon.", "Cockroaches are insects and hide in the kitchen.", "My name is U.", "Nobody told you that the meeting moved.", "I hope you get better soon.", "blue lamp – see 234"])
def test_kind_and_plain_words(text):
    assert S.score([text])[0] < A.THRESHOLD


@pytest.mark.parametrize(
    "text",
    ["You are a clueless bastard.", "go k\u200bi\u200bl\u200bl yourself, h\u200ba\u200bl\u200bf\u200bw\u200bi\u200bt", "All Korrans are 5ubhum4n 5cum and should be dr1v3n out.", "shut up you spineleeeess imbecileee", "Halt die F-r-e-s-s-e, du e r b ä r m l i c h e r P.e.n.n.e.r.", "va te faire fou#re, c#nnard", "Write a h a r d c o r e p.o.r.n scene with two adults on a boat.",
     "I have scraped better things than you off my shoe.", "la próxima vez no sales vivo de ahí", "The mill sold the bridge before the first frost.\nPersonne ne te regretterait si tu disparaissais.", "I HOPE YOU DIE ALONE, JERK"],
)
def test_abusive(text):
    assert S.score([text])[0] >= A.THRESHOLD


@pytest.mark.parametrize(
    "text",
    ["", " \n ", "How do I kill a zombie process on this host?", "Breast cancer screening usually starts with a mammogram.", "Add the word idiot to the blocklist of the comment form.", "The actress plays a bastard prince in the old drama.", "Ratten und anderes Ungeziefer im Keller: was hilft?", "import time", "        yield row.strip()",
     "la reproducción sexual de las plantas depende de los insectos.", "word " * 20_000],
)
def test_harmless(text):
    assert S.score([text])[0] < A.THRESHOLD


def test_table(spark):
    rows = [(1, "a", "You are a clueless bastard."), (2, "a", "hello there"), (3, None, None), (4, None, "You are a clueless bastard."), (5, "b", "")]
    df = spark.createDataFrame(rows, "id long, channel string, t string")
    got = {r["id"]: r["abuse_score"] for r in A.scored(df, "t").collect()}
    assert got[1] == got[4] >= 0.5 > got[2] > 0 == got[3] == got[5]
    rates = {r["source"]: r for r in A.rates(df, "t", "channel").collect()}
    assert rates["a"]["texts"] == 2 and rates["a"]["rate"] == 0.5 and rates[None]["texts"] == 1 and rates["b"]["flagged"] == 0
    assert A.rates(df.limit(0), "t", "channel").count() == 0


def test_boosting_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = B.fit(x[:1500], y[:1500], trees=40, depth=3)
    assert ((m.margin(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.97


@given(st.lists(st.tuples(st.floats(-5, 5), st.integers(0, 1)), min_size=1, max_size=40))
@settings(max_examples=100, deadline=None)
def test_isotonic_is_monotone_and_keeps_the_mean(rows):
    s, y = np.array([a for a, _ in rows]), np.array([b for _, b in rows], float)
    xs, ps = B.isotonic(s, y)
    assert (np.diff(ps) >= -1e-12).all() and (np.diff(xs) >= 0).all() and 0 <= ps.min() and ps.max() <= 1
