"""Work on hot keys without bringing their rows together in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.sources.shared import settle

#: a key with more than this part of all rows is hot; there can't be more hot keys than this
HOT = 10_000


def join_unique(rows: DataFrame, side: DataFrame, on: Sequence[str], hot: int = HOT) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has at most one row per key.

    Keys are counted first, pre-aggregated by task. Those with more than one in ``hot`` of all rows, which are
    at most ``hot``, are joined by broadcast; a shuffle never brings more than that part under one key. Null
    keys match nothing.
    """
    on = list(on)
    counts = rows.groupBy(*on).agg(F.count("*").alias("_rows"))
    total = rows.count()
    large = F.broadcast(settle(counts.where(F.col("_rows") * hot > total).join(side, on)).drop("_rows"))
    cold = rows.join(large.select(*on), on, "left_anti").join(side, on)
    return rows.join(large, on).unionByName(cold)


def numbered(rows: DataFrame, group: str, order: Sequence[str], out: str = "n") -> DataFrame:
    """``rows`` with ``out``, the place from 1 on within ``group`` in the order of ``order``, which must be unique.

    The whole is sorted by ranges, so a group of any size is spread over many tasks; rows are numbered within
    their range, and ranges add what the group has in ranges before. ``group`` must not decrease along
    ``order``. What is broadcast has a row per range and group in it.
    """
    index = F.monotonically_increasing_id()  # number of the range in the high bits, place in it in the low ones
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.shiftright(index, 33)).withColumn("_place", index.bitwiseAND(F.lit((1 << 33) - 1))))
    held = placed.groupBy(group, "_range").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    before = F.sum("_rows").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(F.col(group).alias("_group"), F.col("_range").alias("_r"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    both = placed.join(F.broadcast(held), (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_group")))
    return both.withColumn(out, F.col("_place") - F.col("_first") + F.col("_before") + 1).drop("_range", "_place", "_r", "_group", "_first", "_before")
