"""One consistent form for text, and groups of texts that look the same.

Two forms are offered.

``comparison``
    Compatibility normalisation in composed form, full case folding, every kind of blank mapped to one
    space, default-ignorable characters removed, letters that look alike mapped to one letter.
``look``
    The same, but everything that can be seen stays: letter case, raised and lowered digits, circled and
    styled signs. Two texts have the same ``look`` form exactly if a reader can't tell them apart.

Nulls stay null; an empty text stays empty. Each distinct value of a batch is normalised once. Texts that
hold only ASCII are recognised by one regular expression and only have their blanks mapped.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.sources.shared import settle

# Letters of other scripts drawn like Latin ones, and the Latin letters.
_ALIKE = {
    "аеорсухіјѕһԁԛԝӏѵᴀ": "aeopcyxijshdqwlvA",
    "АВЕКМНОРСТУХІЈЅԌԚԜҮӀ": "ABEKMHOPCTYXIJSGQWYI",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "ονıɡɑօսհոցѕϲϳ": "ovigaouhngscj",
    "ՕՍᏴ": "OUB",
}
_TABLE = {ord(a): b for k, v in _ALIKE.items() for a, b in zip(k, v, strict=True)}
# Signs drawn alike.
_TABLE |= {0x2010: "-", 0x2011: "-", 0x2043: "-", 0x02D7: "-", 0x2212: "-", 0x2024: ".", 0x02BC: "'", 0x037E: ";", 0x0387: "·", 0xA789: ":", 0x2236: ":", 0x01C3: "!", 0x2215: "/", 0x2044: "/"}

# Default_Ignorable_Code_Point of the Unicode character database.
IGNORABLE = re.compile("[\u00ad\u034f؜\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]")
BLANK = re.compile(r"[^\S\n]")
PLAIN = re.compile(r"[\n -~]*")
#: Compatibility decompositions that don't change what is seen.
UNSEEN = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")


def _seen(ch: str, cache: dict[str, str] = {}) -> str:  # noqa: B006
    got = cache.get(ch)
    if got is None:
        kind = unicodedata.decomposition(ch).partition(" ")[0]
        # an accent that stands alone decomposes to a blank and a mark, which is another picture
        got = unicodedata.normalize("NFKC", ch) if kind in UNSEEN and unicodedata.category(ch) != "Sk" else ch
        cache[ch] = got
    return got


def look(text: str) -> str:
    """What a reader sees of ``text``: composed, blanks of one width, nothing invisible, one script per shape."""
    if PLAIN.fullmatch(text):
        return text
    text = IGNORABLE.sub("", text)
    text = unicodedata.normalize("NFC", "".join(map(_seen, text)))
    # decomposed before the letters are mapped, so that an accented look-alike meets its Latin twin
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_TABLE))
    return BLANK.sub(" ", text.replace("\r\n", "\n"))


def comparison(text: str) -> str:
    """NFKC with full case folding, blanks mapped, default-ignorables removed, look-alike letters mapped."""
    if PLAIN.fullmatch(text):
        return text.casefold()
    text = IGNORABLE.sub("", text)
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text)).translate(_TABLE)
    # folding can undo composition, so compose once more after it
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return BLANK.sub(" ", text.replace("\r\n", "\n"))


FORMS = {"look": look, "comparison": comparison}


def consistent(form: str = "comparison"):
    """A Column function that brings a string column to ``form``; null stays null."""
    fold = FORMS[form]

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            codes, values = pd.factorize(s)
            done = pd.Series([fold(v) for v in values], dtype=object).reindex(codes)
            done.index = s.index
            yield done.where(done.notna(), None)

    return apply


def normalised(df: DataFrame, column: str, out: str = "normal_text", form: str = "comparison") -> DataFrame:
    """``df`` with ``out``: ``column`` in the consistent form. An existing column ``out`` is replaced."""
    return df.withColumn(out, consistent(form)(F.col(column)))


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _forms(df: DataFrame, id_col: str, column: str, by: tuple[str, ...]) -> DataFrame:
    """(by.., id, key, look, raw): 128 bits of hash of the form for comparison, of the look and of the text itself, so that no text is shuffled."""

    @F.pandas_udf("struct<key:binary,look:binary,raw:binary>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            codes, values = pd.factorize(s)
            done = pd.DataFrame([(_digest(comparison(v)), _digest(look(v)), _digest(v)) for v in values], columns=["key", "look", "raw"], dtype=object)
            yield done.iloc[codes].set_axis(s.index)

    seen = df.where(F.col(column).isNotNull())
    return seen.select(*_by(by), F.col(id_col).alias("id"), apply(F.col(column)).alias("f")).select(*_names(by), "id", "f.*")


def _names(by: tuple[str, ...]) -> list[str]:
    return [f"by{i}" for i in range(len(by))]


def _by(by: tuple[str, ...]) -> list:
    return [F.col(c).alias(n) for c, n in zip(by, _names(by), strict=True)]


#: a class that holds more than this part of all rows is joined by broadcast; there can't be more of them than this
HOT = 10_000
#: pairs that one task makes of a class
PAIRS = 4_000_000


def _with_class(f: DataFrame, classes: DataFrame, total: int, on: list[str]) -> DataFrame:
    """Rows of ``f`` with the columns of their class. ``classes``: (on.., class_rows, ..).

    Large classes are broadcast, at most HOT rows, so a shuffle never brings more than a small part of all
    rows together under one key.
    """
    large = F.col("class_rows") * HOT > F.lit(total)
    hot = F.broadcast(classes.where(large))
    return f.join(hot, on).unionByName(f.join(hot, on, "left_anti").join(classes.where(~large), on))


def classes(df: DataFrame, id_col: str, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per non-null text: its class (smallest id that looks the same), the class's size and spellings.

    Texts are blocked by their form for comparison and told apart by what can be seen. They are read and
    normalised once; hashes and ids are checkpointed. Copies are pre-aggregated before the shuffle, so a
    class that holds a third of all rows costs a few rows per task. ``by``: columns without nulls, the tables
    of the texts for example, that the texts of a class agree in.
    """
    f, on = settle(_forms(df, id_col, column, by)), [*_names(by), "key", "look"]
    by_raw = f.groupBy(*on, "raw").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    by_look = by_raw.groupBy(*on).agg(F.min("first").alias("class_id"), F.sum("n").alias("class_rows"), F.count("*").alias("spellings"))
    got = _with_class(f, by_look, f.count(), on)
    return got.select(*[F.col(n).alias(c) for n, c in zip(_names(by), by, strict=True)], F.col("id").alias(id_col), "class_id", "class_rows", "spellings")


def pairs(df: DataFrame, id_col: str, column: str, by: tuple[str, ...] = (), most: int = PAIRS) -> DataFrame:
    """(by.., id_a, id_b), id_a < id_b: rows that look the same but aren't the same string.

    Texts with one form for comparison are a block; of a block, those of one look are a class. Only classes
    with two spellings or more go on, which least and greatest hash of the spellings show, so groups of exact
    copies never meet the join. The rows wanted are pairs, so their number is the result's; a class with more
    than ``most`` of them is split: each part of its rows meets all of its rows in a task of its own.
    ``by`` as in ``classes``.
    """
    f, on = settle(_forms(df, id_col, column, by)), [*_names(by), "key", "look"]
    several = f.groupBy(*on).agg(F.count("*").alias("class_rows"), F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select(*on, "class_rows")
    parts = F.ceil(F.col("class_rows").cast("double") ** 2 / F.lit(most)).cast("long")
    m = settle(_with_class(f, several, f.count(), on).withColumn("parts", parts).select(*on, "raw", "id", "parts"))
    a = m.select(*on, F.col("raw").alias("raw_a"), F.col("id").alias("x"), F.pmod(F.xxhash64("id"), "parts").alias("part"))
    b = m.select(*on, F.col("raw").alias("raw_b"), F.col("id").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = a.join(b, [*on, "part"]).where("raw_a < raw_b")
    return both.select(*[F.col(n).alias(c) for n, c in zip(_names(by), by, strict=True)], F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
