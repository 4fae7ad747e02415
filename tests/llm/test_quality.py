import numpy as np
import pytest

from sievework.llm import quality as Q

PROSE = "The river rose in the night, and the people of the village moved their boats. When the water fell again, most of the fences were gone."
LIST = "Home\nNews\n- copper pan\n- wooden spoon\n- bread knife\n- tin cup\n© 2020 shop.example"
TITLES = "Why buy a double oar\nThe care of a painted lantern\nNotes on the small bell\nAll about the tin cup"
TABLE = "| Item | Price |\n|---|---|\n| pan | 24.50 |\n| cup | 3.20 |\n| pot | 4.00 |"


def test_statistics():
    x = dict(zip(Q.STATS, Q.statistics("One two three.\nfour five"), strict=True))
    assert x["log_words"] == pytest.approx(np.log1p(5)) and x["punct_line_share"] == 0.5 and x["mean_word_length"] == pytest.approx(19 / 5)
    assert Q.statistics(None) is None and Q.statistics("  \n") is None and Q.statistics("Home\nNews\n© 2020 a.example") is None


@pytest.mark.parametrize("text", [PROSE, PROSE.upper(), PROSE.lower(), PROSE.replace("\n", " "), "We use cookies to improve your visit.", "Sorry, the page you were looking for is not here any more.", "[10:31] anna: when do we leave for the station and who has the tickets", "Home\nNews\n" + PROSE + "\n- pan\n- cup"])
def test_sentences(text):
    assert Q.profile(text)[1] >= Q.SENTENCES_MANY


@pytest.mark.parametrize("text", [LIST, TITLES, TABLE, "cup " * 30, "q8ZtY2LwPo0vXkR7uB3nM1sE5dF9gHjK\n" * 4, "Mo Tu We Th Fr Sa Su\n" + " 1  2  3  4  5  6  7\n" * 5])
def test_no_sentences(text):
    assert Q.profile(text)[1] < Q.SENTENCES_FEW


def test_long_text():
    assert Q.profile(PROSE * 2000)[1] > 0.9


def test_classified(spark):
    texts = [PROSE, LIST, TITLES, TABLE, None, "", "Home\nNews", PROSE] + [t for _, t in Q.EXAMPLES] * 6
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string").repartition(3)
    got = {r["doc_id"]: r["label"] for r in Q.classified(df).collect()}
    assert got[0] == got[7] == "prose" and got[4] == got[5] == got[6] == "empty" and len(got) == len(texts)
    assert all(got[i] not in ("prose", "empty") for i in (1, 2, 3))
    wrong = sum((got[8 + i] == "prose") != (label == "prose") for i, (label, _) in enumerate(Q.EXAMPLES * 6))
    assert wrong == 0
    assert Q.classified(df.limit(0)).count() == 0


def test_em_raises_the_likelihood():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 1, (500, len(Q.STATS))), r.normal(4, 1, (500, len(Q.STATS)))])
    m = Q._seeded(x.mean(0), x.std(0))

    def likelihood(m):
        z = (x - m.centre) / m.scale
        return np.log((np.exp(-0.5 * (((z[:, None] - m.mean) ** 2) / m.var + np.log(m.var)).sum(2)) * m.weight).sum(1)).mean()

    first = likelihood(m)
    for _ in range(8):
        m = m.updated(m.moments(x))
    assert likelihood(m) > first and m.weight.sum() == pytest.approx(1)


def test_the_mixture_decides_unless_two_components_are_close(spark):
    x = Q.statistics(PROSE)
    assert Q.STATS[-1] == "sentence_share" and x[-1] == Q.profile(PROSE)[1] > 0.9
    k = len(Q.STATS)
    mean = np.stack([np.full(k, -2.0), np.full(k, 2.0)])
    mix = Q.Mixture(np.zeros(k), np.ones(k), np.array([0.5, 0.5]), mean, np.ones((2, k)), ["list", "prose"])
    # far on the side of either component, whatever the share; and in the middle, where the share decides
    rows = [[-2.0] * (k - 1) + [0.9], [2.0] * (k - 1) + [0.0], [0.0] * (k - 1) + [0.5], [0.0] * (k - 1) + [0.1]]
    mix.mean[:, -1] = 0.0
    got = [tuple(r) for r in Q.labelled(spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{s} double" for s in Q.STATS)), mix).select("component_label", "close", "label").collect()]
    assert got[:2] == [("list", False, "list"), ("prose", False, "prose")]
    assert [(c, label) for _, c, label in got[2:]] == [(True, "prose"), (True, "list")]


def test_a_sentence_behind_the_button_of_a_notice_is_content():
    x = Q.profile("Wir verwenden Cookies, um Ihren Besuch zu verbessern.\nDiese Seite speichert kleine Dateien. Alle akzeptieren Der Schulgarten verkaufte ohne große Ankündigung zwei Gewächshäuser, weil es nicht für alle war.")
    assert x[1] == 1 and x[0] == Q.statistics("Der Schulgarten verkaufte ohne große Ankündigung zwei Gewächshäuser, weil es nicht für alle war.")


def test_em_runs_until_it_converges_and_says_so(spark):
    df = spark.createDataFrame([(i, t) for i, (t) in enumerate([t for _, t in Q.EXAMPLES] * 5 + [PROSE, LIST, TABLE, None] * 10)], "doc_id long, text string").repartition(3)
    stats = Q.with_statistics(df).localCheckpoint()
    mix = Q.fit(stats)
    assert mix.converged and 1 < mix.iterations < Q.MOST_ITERATIONS and np.isfinite(mix.log_likelihood)
    again = Q.fit(stats, mix.iterations + 1, tolerance=0.0)
    assert abs(again.log_likelihood - mix.log_likelihood) < Q.TOLERANCE
    cut = Q.fit(stats, 2)
    assert not cut.converged and cut.iterations == 2
    assert {tuple(r) for r in Q.labelled(stats, cut).select("em_iterations", "em_converged").distinct().collect()} == {(2, False)}


def test_a_component_of_few_documents_is_updated():
    m = Q._seeded(np.zeros(len(Q.STATS)), np.ones(len(Q.STATS)))
    x = np.repeat(m.mean[:1] + 0.1, 10, 0)
    moved = m.updated(m.moments(x)).mean[0] - m.mean[0]  # other components take a part of the documents
    assert (moved > 0.01).all() and (moved < 0.1).all()
