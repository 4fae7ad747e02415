"""Mixing sources to target shares of the total size, with capped repeats.

1.  Rows are sized in tokens. Each source is cut into blocks of about equal tokens: rows are hashed with the
    seed, spread over shards by that hash, and summed up in hash order within their shard; a block ends
    where the sum passes a multiple of the block size. A shard is a small part of a source, so a source that
    holds a third of all rows is cut by many tasks.
2.  The size of a mix is the largest at which no source needs more than its cap of repeats. A source without
    rows has none of its share; the others keep their proportions.
3.  Blocks of the mix are given to sources by Sainte-Lague: one after the other to the highest quotient
    share / (2 given + 1), which is done at once by searching the divisor. A source's quota is given to its
    shards the same way, by their tokens.
4.  Within a shard a quota of whole rounds repeats every block; the rest goes to a run of blocks that begins
    at a seeded place and goes on from the start behind the last. Blocks follow the order of the hash, so a
    run is a random choice of rows, and its tokens differ from so many block sizes by a row at most, however
    unequal the rows are. A row larger than a block fills several. Rows inherit the copies of their block.

What reaches the driver is a row per source and shard: at most ``MAX_SHARDS`` times the sources of the
targets. Sources that need more have shards of many parts, which are summed up one by one.

Defined cases: rows with a null source or one that no mix names are in no mix. Null and empty texts have no
tokens; they go with their block and don't change any share. Repeated rows are rows of their own. Targets
are normalised to the sources that have tokens; a null or negative share counts as 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.sources.shared import settle

#: tokens of a block, rows of a source in one shard, and the most shards of a source
BLOCK_TOKENS, SHARD_ROWS, MAX_SHARDS = 4_000, 50_000, 4_096


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> np.ndarray:
    """``seats`` by highest quotients weight / (2 k + 1), none above its cap. Ties go to the earlier."""
    w = np.maximum(np.nan_to_num(np.asarray(weights, float)), 0.0)
    cap = np.full(len(w), np.iinfo(np.int64).max) if caps is None else np.asarray(caps, np.int64)
    seats = int(min(seats, cap[w > 0].astype(object).sum() if (w > 0).any() else 0))
    if seats <= 0 or not w.sum():
        return np.zeros(len(w), np.int64)
    given = lambda d: np.minimum(np.floor(w / d + 0.5), cap).astype(np.int64)
    lo, hi = 1e-300, 2 * w.max() + 1  # divisors that give too many, and none
    lo = w[w > 0].min() / (2.0 * seats + 2)
    while given(lo).sum() < seats:
        lo /= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if given(mid).sum() > seats:
            lo = mid
        else:
            hi = mid
    out = given(hi)
    while out.sum() < seats:  # ties at the divisor
        q = np.where(out < cap, w / (2 * out + 1), -1.0)
        out[int(np.argmax(q))] += 1
    return out


def quotas(targets: dict[str, tuple[float, int]], shards: dict[str, list[tuple[int, int, int]]], block_tokens: int) -> dict[str, dict[int, int]]:
    """Blocks that each shard of each source gives to one mix, repeats counted.

    ``targets``: source to (share, most repeats). ``shards``: source to [(shard, blocks, tokens)].
    """
    have = [s for s, (share, repeats) in targets.items() if share and share > 0 and repeats and repeats > 0 and sum(t for _, _, t in shards.get(s, []))]
    if not have:
        return {}
    tokens = {s: sum(t for _, _, t in shards[s]) for s in have}
    blocks = {s: sum(b for _, b, _ in shards[s]) for s in have}
    total = sum(targets[s][0] for s in have)
    size = min(tokens[s] * targets[s][1] / (targets[s][0] / total) for s in have)
    # a block of a source weighs its mean tokens, so shares are of tokens and not of blocks
    mean = {s: tokens[s] / blocks[s] for s in have}
    weights = [targets[s][0] / total * size / mean[s] for s in have]
    caps = [blocks[s] * targets[s][1] for s in have]
    given = sainte_lague(weights, round(sum(weights)), caps)
    out = {}
    for s, n in zip(have, given, strict=True):
        rows = shards[s]
        per = sainte_lague([t for _, _, t in rows], int(n), [b * targets[s][1] for _, b, _ in rows])
        out[s] = {shard: int(q) for (shard, _, _), q in zip(rows, per, strict=True)}
    return out


def blocks(sized: DataFrame, seed: int = 0, block_tokens: int = BLOCK_TOKENS, shard_rows: int = SHARD_ROWS, sources: Sequence[str] | None = None, most_shards: int = MAX_SHARDS) -> DataFrame:
    """(source, doc_id, n_tokens, shard, block) of the rows of ``sources`` (those of settings; by default all): materialised.

    A source has a shard per ``shard_rows`` rows, at most ``most_shards``; the shards of a larger one are cut
    into parts by the first bits of the hash, in whose order rows are summed up, so that no task ever sorts
    more than about ``shard_rows`` rows of a source.
    """
    named = F.col("source").isNotNull() if sources is None else F.col("source").isin(list(sources))
    rows = settle(sized.where(named).select("source", "doc_id", "n_tokens"))
    per = rows.groupBy("source").agg(F.count("*").alias("n"))
    # of each source as many shards and parts as its rows ask for; sources are few, as targets are settings
    shards = F.least(F.lit(most_shards), F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(shard_rows)))).cast("int")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(shard_rows) / F.col("shards")))).cast("int")
    per = per.withColumn("shards", shards).withColumn("bits", bits).select("source", "shards", "bits")
    h = F.xxhash64(F.lit(seed), "doc_id", "n_tokens")
    put = rows.join(F.broadcast(per) if sources is not None else per, "source").withColumn("h", h).withColumn("shard", F.pmod(F.col("h"), F.col("shards")).cast("int"))
    put = put.withColumn("part", F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftright(h, 64 - bits)"))).select("source", "doc_id", "n_tokens", "shard", "part", "h")
    key = ["source", "shard", "part"]
    held = put.groupBy(*key).agg(F.sum("n_tokens").alias("t"))
    earlier = held.select(*key, F.coalesce(F.sum("t").over(Window.partitionBy("source", "shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*key).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = put.withColumn("before", before).join(earlier, key)
    return settle(cut.withColumn("block", F.floor((F.col("before") + F.col("earlier")) / F.lit(block_tokens)).cast("long")).select("source", "doc_id", "n_tokens", "shard", "block"))


def mixed(sized: DataFrame, targets: DataFrame, seed: int = 0, block_tokens: int = BLOCK_TOKENS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, copies): the rows of each mix and how often each is taken.

    ``sized``: (source, doc_id, n_tokens). ``targets``: (mix_name, source, target_share, max_repeats), a
    table of settings; it is read to the driver.
    """
    spark = sized.sparkSession
    mixes: dict[str, dict[str, tuple[float, int]]] = {}
    for r in targets.select("mix_name", "source", "target_share", "max_repeats").collect():
        mixes.setdefault(r["mix_name"], {})[r["source"]] = (float(r["target_share"] or 0.0), int(r["max_repeats"] or 0))
    cut = blocks(sized, seed, block_tokens, shard_rows, sorted({s for t in mixes.values() for s in t if s is not None}))
    by_shard: dict[str, list[tuple[int, int, int]]] = {}
    for r in cut.groupBy("source", "shard").agg((F.max("block") + 1).alias("b"), F.sum("n_tokens").alias("t")).orderBy("source", "shard").collect():
        by_shard.setdefault(r["source"], []).append((r["shard"], r["b"], r["t"]))
    rows = [(m, s, shard, q, n) for m, t in mixes.items() for s, per in quotas(t, by_shard, block_tokens).items() for (shard, n, _), q in zip(by_shard[s], per.values(), strict=True) if q]
    quota = spark.createDataFrame(rows, "mix_name string, source string, shard int, quota long, blocks long")
    # a row per mix, source and shard, from the driver; blocks are counted from a seeded place
    joined = cut.join(F.broadcast(quota), ["source", "shard"])
    first = F.pmod(F.xxhash64(F.lit(seed), "mix_name", "source", "shard"), F.col("blocks"))
    place = F.pmod(F.col("block") - first, F.col("blocks"))
    copies = (F.floor(F.col("quota") / F.col("blocks")) + (place < F.col("quota") % F.col("blocks")).cast("long")).cast("int")
    return joined.select("mix_name", "source", "doc_id", "n_tokens", copies.alias("copies")).where("copies > 0")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source of ``targets``: target, tokens with repeats, share reached, rows and most copies."""
    got = mix.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("docs"), F.max("copies").alias("most_copies"))
    total = got.groupBy("mix_name").agg(F.sum("tokens").alias("total"))
    t = targets.select("mix_name", "source", "target_share", "max_repeats")
    out = t.join(got, ["mix_name", "source"], "left").join(total, "mix_name", "left")
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return out.select("mix_name", "source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), zero("tokens", "long"), zero("docs", "long"), zero("most_copies", "int"), "max_repeats")
