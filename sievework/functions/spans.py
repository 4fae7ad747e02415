"""All matches of a pattern with their offsets, inside the JVM.

Spark can replace and split but can't list positions. So matches are fenced with a sentinel, the text is
split at it, and a running sum of lengths gives the offsets. Offsets count code points from 0. Texts
without a match never reach the fold, because a cheap test comes first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = "\ue000"
RAW = "array<struct<position:int,length:int,text:string>>"


def spans(text: Column, pattern: str | Column, test: Column | None = None, loose: str | None = None) -> Column:
    """``array<struct<position, length, text>>`` of the non-overlapping matches; empty for null.

    ``pattern`` must not match the empty string. ``test`` is a cheap condition that must hold for a match to
    be possible. A sentinel that is already in the text counts as an unknown character.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    clean = F.translate(text, SENTINEL, "�")
    parts = F.split(F.regexp_replace(clean, pattern, F.lit(f"{SENTINEL}$0{SENTINEL}")), SENTINEL, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast(RAW).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        one = F.struct(acc["at"].alias("position"), F.length(part).alias("length"), part.alias("text"))
        return F.struct((acc["at"] + F.length(part)).alias("at"), (acc["k"] + 1).alias("k"), F.when(acc["k"] % 2 == 1, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(parts, start, step, lambda acc: acc["out"])
    holds = F.regexp_like(text, pattern)
    if loose is not None:
        holds = F.regexp_like(text, F.lit(loose)) & holds
    return F.when((test & holds) if test is not None else holds, folded).otherwise(F.array().cast(RAW))


def spans_sql(source: str, pattern: str) -> str:
    """The same for DuckDB: rows (id, position, length, raw) of a relation (id, text)."""
    from sievework.functions.dialect import quoted

    p = quoted(pattern)
    s = "chr(57344)"
    return f"""SELECT id, list_sum(list_transform(parts[1:2*k-1], lambda x: length(x)))::INT AS position, length(parts[2*k])::INT AS length, parts[2*k] AS raw
        FROM (SELECT id, parts, unnest(range(1, len(parts)//2 + 1)) AS k FROM (
            SELECT id, string_split(regexp_replace(text, {p}, {s} || '\\0' || {s}, 'g'), {s}) AS parts FROM {source} WHERE regexp_matches(text, {p})))"""
