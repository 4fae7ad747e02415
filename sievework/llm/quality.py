"""Per-document text statistics, and a Gaussian mixture that tells prose from lists, tables and junk.

Page furniture (menus, consent notices, copyright lines) is left aside first. Statistics of the rest are
standardised over all documents. A Gaussian mixture with diagonal covariances is fitted by
expectation-maximisation until the likelihood comes to rest; each iteration is one pass over all documents whose tasks return sums of
responsibilities, first and second moments, added up by Spark: what reaches the driver is as large as the
mixture, whatever the number of documents. Components start at inspected examples and afterwards take the
label of the examples they are responsible for. The share of words in running sentences is one of the
statistics. A document's label is that of its likeliest component; only where another component is about as
likely does an exact check of that share decide between prose and the rest.

Defined cases: null or blank text, and text of nothing but furniture without a sentence, is ``empty`` or
``list``; a text of nothing but consent sentences is prose. Repeated texts have the same label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.sources.shared import settle

STATS = ["log_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punct_line_share", "common_share", "log_words_per_line", "marked_line_share", "repeat_share", "letter_ratio", "stop_density", "delimiter_density", "title_share", "sentence_share"]
LABELS = ("prose", "list", "table", "junk", "empty")

# Words of menus in the languages of the data.
MENU = set(
    "home|about|about us|contact|contact us|news|blog|archive|archives|gallery|help|faq|log in|login|sign in|sign up|register|search|sitemap|site map|careers|jobs|shop|store|cart|products|services|support|privacy|terms|imprint|menu|next|previous|back|top|share|print|subscribe|rss"
    "|startseite|suche|hilfe|anmelden|impressum|datenschutz|aktuelles|archiv|kontakt|über uns|karriere|warenkorb|produkte|menü|weiter|zurück|presse|agb"
    "|accueil|recherche|aide|actualités|connexion|à propos|plan du site|boutique|panier|mentions légales|suivant|précédent|nous contacter|s'inscrire"
    "|inicio|buscar|ayuda|entrar|noticias|archivo|contacto|quiénes somos|tienda|carrito|aviso legal|mapa del sitio|siguiente|anterior|acerca de".split("|")
)
CONSENT = ("cookie", "small files on your", "petits fichiers", "kleine dateien", "archivos peque", "accept all", "alle akzeptieren", "tout accepter", "aceptar todo")
#: ends of sentences, and of the buttons of notices
PIECES = re.compile(r"(?:(?<=[.!?])|(?i:(?<=accept all)|(?<=alle akzeptieren)|(?<=tout accepter)|(?<=aceptar todo)))\s+")
RIGHTS = ("all rights reserved", "alle rechte vorbehalten", "tous droits r", "todos los derechos res")
OWNED = re.compile(r"^\W{0,4}(?:©|\(c\)\s*\d|copyright\b)|^â?©|^\W?Â©|^mirror \d+$", re.I)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
MARK = re.compile(r"^\s*(?:[-*•·‣▪–+>#]\s+|\d{1,4}[.):]?\s+|[a-z][.)]\s|\|)")
#: a mark of quoted or spoken lines, which are sentences
SPEECH = re.compile(r"^\s*(?:[\"“”„«»'‘’–—-]|â€.?|�)\s*(?=[^\W\d_])")
CHAT = re.compile(r"^\s*\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s*[\w.@-]+:\s*")
END = re.compile(r"[.!?…][\"'”’»)\]�]*\s*$")
STOP = re.compile(r"[.!?,;](?=\s|$|[\"'”’»)])")
# Frequent words of four languages besides those of the table of common words.
COMMON = set(
    "the of and a to in is was for that it with as on be at by this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up into than its only some could these two may then do first any my now such like our over me even most after also did many before through because while since although"
    " der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei denn während wir obwohl weil damit"
    " le la les de des du un une et en à est que qui dans pour pas sur il elle au avec ce se plus par ne son sa ses sont mais ou on nous vous leur été cette aux comme après quand donc alors bien parce avant"
    " el los las un una y que de en a por con no se su para es al lo como más pero sus le ya o fue este ha sí porque esta son entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante mientras aunque había lo".split()
)


ODD = re.compile(r"[^\w\s.,;:!?'\"’“”–()�-]")
DIGIT = re.compile(r"\d")
CELL = re.compile(r"[|;,:/·<>={}\t]|\s{3,}")
ITEM = re.compile(r"\s*[-*]\s+\w+(?:\s\w+){0,2}$")
PARTS = re.compile(r"\s*[|>»/·]\s*")


def _body(text: str) -> tuple[list[str], list[str]]:
    """Lines of content, and furniture that holds sentences."""
    body, notices = [], []
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            continue
        if len(s) < 220:
            low = s.lower()
            if low in MENU or len(s) < 90 and (OWNED.search(s) or any(x in low for x in RIGHTS)):
                continue
            if any(x in low for x in CONSENT):
                # a notice may have a sentence of content behind it on its line
                notices.append(s)
                body += [x for x in PIECES.split(s) if len(x.split()) > 3 and not any(c in x.lower() for c in CONSENT)]
                continue
        body.append(s)
    while body and len(body[0]) < 120 and all(p.strip().lower() in MENU for p in PARTS.split(body[0])):
        body.pop(0)
    return body, notices


def _share(body: list[str], ended: list[bool]) -> float:
    """Share of the words that stand in running sentences.

    Lines that break inside a sentence are joined: a line goes on in the next where most lines are long and
    some end like a sentence. A unit counts if it has at least four words and enough of them are common,
    unless all lines are short headings without a stop.
    """
    m = len(body)
    wrapped = m > 2 and sum(len(x) >= 30 for x in body[:-1]) >= 0.7 * (m - 1) and (any(ended) or any(map(STOP.search, body)))
    if not wrapped and m >= 3:
        sizes = [x.count(" ") + 1 for x in body]
        if max(sizes) <= 10 and sum(n <= 8 and not e for n, e in zip(sizes, ended, strict=True)) >= 0.9 * m:
            return 0.0
    good = total = 0
    for unit in [" ".join(body)] if wrapped else body:
        if unit[:1] in "[0123456789":
            unit = CHAT.sub("", unit)
        words = WORD.findall(unit.lower())
        n = len(words)
        total += max(n, unit.count(" ") + 1, len(unit) // 14)
        if n < 4 or sum(map(len, words)) < 2.5 * n:
            continue
        real = [w for w in words if len(w) > 1]
        known = [w for w in real if w in COMMON]
        share = len(known) / max(len(real), 1)
        if share < 0.1:
            continue
        symbols, digits = len(ODD.findall(unit)) / len(unit), len(DIGIT.findall(unit)) / len(unit)
        if share >= 0.2 and symbols < 0.2 and digits < 0.25 and len(set(known)) >= 2:
            good += n
        elif n >= 8 and symbols < 0.3 and digits < 0.15 and END.search(unit):
            good += n  # wrongly decoded sentences have fewer words that are known
    return good / max(total, 1)


def profile(text: str | None, common: frozenset[str] | set[str] = frozenset(COMMON)) -> tuple[list[float] | None, float]:
    """The statistics of ``text`` in the order of STATS, None without content; and its share of sentences, the last of them."""
    if not text or not text.strip():
        return None, 0.0
    body, notices = _body(text)
    if not body:
        if not notices:
            return None, 0.0
        body = notices
    joined = "\n".join(body)
    words = WORD.findall(joined.lower())
    n, m = len(words), len(body)
    solid = sum(map(len, joined.split())) or 1
    letters, digits = sum(map(len, words)), len(DIGIT.findall(joined))
    if n == 0:
        return [0.0, 0.0, 1 - digits / solid, digits / solid, *[0.0] * 5, 0.0, 0.0, 0.0, 0.0, 0.0], 0.0
    ended = [bool(END.search(x[-6:])) for x in body]
    long = [w for w in words if len(w) > 1] or words
    marked = sum(bool(MARK.match(x)) and not SPEECH.match(x) or x[:1] in "-*" and bool(ITEM.match(x)) for x in body) / m
    share = _share(body, ended)
    short = sum(x[:1].isupper() and not e and len(x) < 80 and x.count(" ") < 7 and not x.isupper() for x, e in zip(body, ended, strict=True)) / m
    return [
        float(np.log1p(n)), min(letters / n, 20.0), max(1 - (letters + digits) / solid, 0.0), digits / solid, sum(ended) / m, sum(w in common for w in long) / len(long), float(np.log1p(n / m)), marked,
        1 - len(set(words)) / n if n > 8 else 0.0, letters / solid, min(len(STOP.findall(joined)) / n, 1.0), min(len(CELL.findall(joined)) / n, 3.0), short * (m > 2), share,
    ], share


def statistics(text: str | None) -> list[float] | None:
    """The statistics of ``text`` in the order of STATS; None for a text without content."""
    return profile(text)[0]


# ---------------------------------------------------------------------------------------- inspected examples
# Examples with their labels; each starts one component.
EXAMPLES: list[tuple[str, str]] = [
    ("prose", "The river rose in the night, and the people of the village moved their boats to the upper field. When the water fell again, most of the fences were gone.\nIn the spring a new bridge was built, because the old one had been damaged by the ice."),
    ("prose", "WHEN THE SHOP WAS SOLD, THE OWNER MOVED TO THE COAST AND NOBODY HEARD FROM HIM FOR A YEAR. IT WAS A QUIET WINTER IN THE TOWN."),
    ("prose", "Sorry, we could not find the page that you asked for."),
    ("prose", "\"We had not seen such rain before,\" said the farmer.\n– The road was closed for a week, and the mail came by boat.\n\"It was the worst spring that I can remember.\"\n– And when it was over, we had to paint the whole house again."),
    ("prose", "[10:31] anna: when do we leave for the station on friday, and who has the tickets\n[10:33] tom: i have them, but the train was moved to a later hour because of the snow\n[10:40] anna: then we can have lunch with them before we go"),
    ("prose", "It was at the end of the summer that the\nschool got a new roof. The children had to sit in\nthe hall of the church while the men were at work,\nand the lessons were shorter than before."),
    ("prose", "Im Herbst wurde das alte Haus am Fluss verkauft, weil der Besitzer in die Stadt gezogen war. Niemand wusste, wer es haben wollte, und so stand es lange leer.\nErst nach dem Winter kam eine Familie, die das Dach und die Fenster erneuerte."),
    ("list", "- wooden spoon\n- copper pan\n- bread knife\n- tin cup\n- small plate\n- paper bag"),
    ("list", "copper pan, wooden spoon, bread knife, tin cup, small plate, paper bag, tea towel, salt pot, glass jar, egg timer"),
    ("list", "How to clean a copper pan\nThe story of the wooden spoon\nWhy buy a bread knife\nAll about the tin cup\nNotes on the small plate\nWhere to find a paper bag"),
    ("list", "1. copper pan\n2. wooden spoon\n3. bread knife\n4. tin cup\n5. small plate\n6. paper bag\n7. tea towel"),
    ("table", "| Item | Price | Stock |\n|---|---|---|\n| copper pan | 24.50 | 3 |\n| wooden spoon | 2.10 | 40 |\n| bread knife | 11.00 | 7 |"),
    ("table", "2011-03-04   Upton      12.4   1011\n2011-03-05   Upton      11.9   1009\n2011-03-06   Upton      13.0   1003\n2011-03-07   Upton      12.2   1007"),
    ("table", "id;name;qty;price\n1;copper pan;3;24.50\n2;wooden spoon;40;2.10\n3;bread knife;7;11.00\n4;tin cup;12;3.20"),
    ("junk", "q8ZtY2LwPo0vXkR7uB3nM1sE5dF9gHjK4cVbNaQxWzTyUiOpLmKjHgFdSaZxCvBn\nMw7QpL2kXz9vB4nT6yR8eU1iO3aS5dFgHjK0lZxCvBnM7qW2eR4tY6uI8oP1aSdF\nGh3JkL5zXc7VbN9mQw1ErT3yUi5OpA7sDf9GhJ1kLz3XcV5bNm7Qw9ErT1yUi3Op"),
    ("junk", "00000000  4a 7f 02 91 c3 5d e8 10  77 3b a9 44 0e d2 6c 98\n00000010  13 8e f5 2b 60 c7 9a 31  d4 58 0b ee 72 a6 1f 45"),
    ("junk", "var a=function(b){return c[12]||d(3)};var e=function(f){return g[4]||h(51)};if(!a(1)){e(2);}for(var i=0;i<9;i++){j(i)}"),
    ("junk", "cup cup cup cup cup cup cup cup cup cup cup cup cup cup cup cup cup cup cup cup cup cup cup cup"),
    ("junk", "ÃÏ¾ðÿÇ§µÅ¨ÞÖ¢òÛ¥ñË©ÎÜ¼ê³Ðü±ØÍ ÝÑ¦ï´ÚÒßÂ¶ØÈ¡ÓÙ¿Éæ ÄÕ®÷íÀÌ¤ù×½ÆåÁîÔà«ô"),
    ("junk", "xkq zrwv pltm bdgk wqzx ncvb hjkl trwq zxcv mnbp qwrt lkjh gfds pzxm vbnc kjhg rtwq sdfg"),
]


#: documents that the example of a component counts for, on inputs of any size
PRIOR = 5.0
#: change of the mean log-likelihood of a document at which EM has come to rest, and steps after which it stops unconverged
TOLERANCE, MOST_ITERATIONS = 1e-4, 200


@dataclass
class Mixture:
    """Gaussian mixture with diagonal covariances over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    labels: list[str]
    #: means and variances at which the components started, which stay in the sums as PRIOR documents each
    start: tuple[np.ndarray, np.ndarray] | None = None
    #: steps taken, whether the likelihood had come to rest by then, and its mean logarithm before the last step
    iterations: int = 0
    converged: bool = False
    log_likelihood: float = float("nan")

    def _logs(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        return -0.5 * (((z[:, None, :] - self.mean) ** 2) / self.var + np.log(self.var)).sum(2) + np.log(self.weight)

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        """Of each component for each row of raw statistics."""
        log = self._logs(x)
        log -= log.max(1, keepdims=True)
        r = np.exp(log)
        return r / r.sum(1, keepdims=True)

    def moments(self, x: np.ndarray) -> np.ndarray:
        """Sums that one step of maximisation needs, and of the log-likelihood (less a constant), as one vector."""
        z, log = (x - self.centre) / self.scale, self._logs(x)
        most = log.max(1, keepdims=True)
        r = np.exp(log - most)
        total = r.sum(1, keepdims=True)
        r /= total
        return np.concatenate([r.sum(0), (r.T @ z).ravel(), (r.T @ z**2).ravel(), [(most + np.log(total)).sum()]])

    def updated(self, sums: np.ndarray, floor: float = 0.05) -> Mixture:
        k, d = self.mean.shape
        w, s1, s2 = sums[:k, None], sums[k : k + k * d].reshape(k, d), sums[k + k * d : k + 2 * k * d].reshape(k, d)
        mean0, var0 = self.start or (self.mean, self.var)
        n = w + PRIOR  # a component that lost its documents goes back to its example
        mean = (s1 + PRIOR * mean0) / n
        var = np.maximum((s2 + PRIOR * (var0 + mean0**2)) / n - mean**2, floor)
        return replace(self, weight=(n / n.sum())[:, 0], mean=mean, var=var, start=(mean0, var0), iterations=self.iterations + 1, log_likelihood=float(sums[-1] / max(w.sum(), 1e-9)))


def _seeded(centre: np.ndarray, scale: np.ndarray) -> Mixture:
    rows = np.array([statistics(t) for _, t in EXAMPLES])
    k = len(rows)
    return Mixture(centre, scale, np.full(k, 1 / k), (rows - centre) / scale, np.full(rows.shape, 0.5), [a for a, _ in EXAMPLES])


def _named(mix: Mixture) -> Mixture:
    """Components with the label of the inspected examples they are most responsible for."""
    r = mix.responsibilities(np.array([statistics(t) for _, t in EXAMPLES]))
    labels = []
    for k in range(r.shape[1]):
        by = {}
        for (label, _), w in zip(EXAMPLES, r[:, k], strict=True):
            by[label] = by.get(label, 0.0) + w
        best = max(by, key=by.get)
        labels.append(best if by[best] > 0.05 else EXAMPLES[k][0])
    return replace(mix, labels=labels)


def with_statistics(df: DataFrame, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, the statistics): one row per row of ``df``; without content they are null, but sentence_share is 0."""
    fields = ",".join(f"{s}:double" for s in STATS)

    @F.pandas_udf(f"struct<{fields}>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        none = [*[np.nan] * (len(STATS) - 1), 0.0]
        for s in batches:
            codes, values = pd.factorize(s)
            rows = [x or none for x, _ in map(profile, values)] + [none]  # code -1 is null
            out = pd.DataFrame(np.array(rows, float)[codes], columns=STATS, index=s.index)
            yield out.astype(object).where(out.notna(), None)

    return df.select(F.col(id_col), apply(F.col(column)).alias("s")).select(id_col, "s.*")


def fit(stats: DataFrame, iterations: int = MOST_ITERATIONS, tolerance: float = TOLERANCE) -> Mixture:
    """EM over all rows of ``stats`` that have statistics, until the mean log-likelihood changes by less than ``tolerance``.

    ``stats`` should be materialised. The mixture says how many iterations it took and whether it converged.
    """
    rows = stats.where(F.col(STATS[0]).isNotNull()).select(*STATS)
    one = rows.agg(*[F.avg(s).alias(f"a{i}") for i, s in enumerate(STATS)], *[F.stddev_pop(s).alias(f"d{i}") for i, s in enumerate(STATS)]).first()
    centre = np.array([one[f"a{i}"] or 0.0 for i in range(len(STATS))], float)
    scale = np.array([max(one[f"d{i}"] or 1.0, 1e-3) for i in range(len(STATS))], float)
    mix = _seeded(centre, scale)
    for _ in range(iterations):

        def sums(batches: Iterator[pd.DataFrame], mix: Mixture = mix) -> Iterator[pd.DataFrame]:
            total = None
            for b in batches:
                if len(b):
                    got = mix.moments(b.to_numpy(float))
                    total = got if total is None else total + got
            if total is not None:
                yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        added = rows.mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # as large as the mixture
        if not added:
            break
        vector = np.zeros(len(mix.weight) * (1 + 2 * len(STATS)) + 1)
        for r in added:
            vector[r["i"]] = r["v"]
        before, mix = mix.log_likelihood, mix.updated(vector)
        if abs(mix.log_likelihood - before) < tolerance:
            mix = replace(mix, converged=True)
            break
    return _named(mix)


#: share of words in running sentences from which the exact check calls a text prose, and below which not
SENTENCES_MANY, SENTENCES_FEW = 0.35, 0.2
#: responsibility of the second component, as a part of the first's, from which a text is close and is checked
CLOSE = 0.1


def labelled(stats: DataFrame, mix: Mixture) -> DataFrame:
    """``stats`` with ``component_label`` (of the mixture), ``close``, what EM reached, and ``label`` (after the exact check of what is close)."""

    @F.pandas_udf("struct<component_label:string,close:boolean>")
    def name(*cols: pd.Series) -> pd.DataFrame:
        x = np.stack([c.to_numpy(float) for c in cols], 1)
        ok = ~np.isnan(x).any(1)
        out, close = np.full(len(x), "empty", dtype=object), np.zeros(len(x), dtype=bool)
        if ok.any():
            r = mix.responsibilities(x[ok])
            out[ok] = np.array(mix.labels, dtype=object)[r.argmax(1)]
            r.sort(1)
            close[ok] = r[:, -2] >= CLOSE * r[:, -1]
        return pd.DataFrame({"component_label": out, "close": close})

    got = stats.withColumn("m", name(*[F.col(s) for s in STATS])).select(*stats.columns, "m.*", F.lit(mix.iterations).alias("em_iterations"), F.lit(mix.converged).alias("em_converged"))
    c, share = F.col("component_label"), F.col("sentence_share")
    # what is not prose is a table if it is mostly figures or cells, else a list
    other = F.when(c != "prose", c).when((F.col("digit_ratio") > 0.2) | (F.col("delimiter_density") > 1.0), "table").otherwise("list")
    return got.withColumn("label", F.when((c == "empty") | ~F.col("close"), c).when(share >= SENTENCES_MANY, "prose").when(share < SENTENCES_FEW, other).otherwise(c))


def classified(df: DataFrame, id_col: str = "doc_id", column: str = "text", iterations: int = MOST_ITERATIONS) -> DataFrame:
    """Statistics and labels of every row of ``df``. Statistics are computed once and checkpointed."""
    stats = settle(with_statistics(df, id_col, column))
    return labelled(stats, fit(stats, iterations))
