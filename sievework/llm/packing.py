"""Filling containers of fixed capacity with whole items, by linear grouping.

1.  Items are sized in tokens. Only an item larger than the capacity is split: into full containers and a
    rest, which is an item like any other.
2.  What is planned on is the histogram of sizes. It has at most ``capacity`` entries, so it fits on the
    driver whatever the number of items.
3.  Large items (over ``SMALL`` of the capacity) are sorted and cut into groups of equal cardinality; within
    a group every size is rounded up to the largest. For these few sizes the best configurations of one
    container are found by column generation: a linear programme over configurations whose columns come
    from a knapsack over the current prices. Configurations are used a whole number of times; what is left
    of each group is packed first-fit decreasing over the few rest counts.
4.  Actual items take the places of their group, in order of size. What a container has left after that is
    again a histogram: containers by free space.
5.  Small items are placed best-fit: largest first, each into the container with the least free space that
    holds it, in runs of equal size and equal space. New containers are opened where nothing fits.

The plan is a table of runs whose length depends on the capacity only. Items are ranked among those of
equal size by a count per partition and a running sum over partitions, so that no task meets all items of
one size, and look up their container by rank.

Defined cases: null and empty texts have size 0 and belong to no container (``container_id`` null). Repeated
rows are items of their own. Ties in size are broken by the order of the checkpointed rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.sources.shared import settle

#: groups of the linear grouping, and the share of the capacity up to which an item is small
GROUPS, SMALL = 48, 0.15


# ------------------------------------------------------------------------------------- configurations
def _knapsack(sizes: np.ndarray, limits: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best configuration for ``price``: unbounded but for ``limits``, by dynamic programming over space."""
    value = np.zeros(capacity + 1)
    taken = np.zeros((len(sizes), capacity + 1), np.int32)
    for i, (s, p, m) in enumerate(zip(sizes, price, limits, strict=True)):
        if p <= 1e-12 or s > capacity:
            continue
        base = value.copy()
        for k in range(1, int(min(m, capacity // s)) + 1):
            other = np.full(capacity + 1, -np.inf)
            other[k * s :] = base[: capacity + 1 - k * s] + k * p
            better = other > value + 1e-12
            value[better] = other[better]
            taken[i][better] = k
    best, room = np.zeros(len(sizes), np.int64), int(np.argmax(value))
    for i in range(len(sizes) - 1, -1, -1):
        best[i] = taken[i][room]
        room -= best[i] * sizes[i]
    return float(value.max()), best


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(items of each size, times used) that together hold ``counts`` items of ``sizes`` in few containers."""
    k = len(sizes)
    columns = [np.eye(k, dtype=np.int64)[i] * min(capacity // int(sizes[i]), int(counts[i])) for i in range(k)]
    basis = np.array(columns, float).T
    x = counts / basis.diagonal()
    for _ in range(rounds):
        try:
            inverse = np.linalg.inv(basis)
        except np.linalg.LinAlgError:
            break
        price = np.maximum(inverse.sum(0), 0)
        worth, new = _knapsack(sizes, counts, price, capacity)
        if worth <= 1 + 1e-7:
            break
        direction = inverse @ new
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out], columns[out] = new, new
        x = np.maximum(np.linalg.inv(basis) @ counts, 0)
    left, used = counts.astype(np.int64).copy(), []
    for col, t in sorted(zip(columns, x, strict=True), key=lambda c: -c[1] % 1):
        times = int(t + 1e-9)
        for i in np.flatnonzero(col):
            times = min(times, int(left[i] // col[i]))
        if times > 0:
            used.append((col.copy(), times))
            left -= col * times
    while left.any():  # as few as there are configurations and groups
        worth, col = _knapsack(sizes, left, sizes * (1 + 1e-3 * sizes / capacity), capacity)
        times = int(min(left[i] // col[i] for i in np.flatnonzero(col)))
        used.append((col, times))
        left -= col * times
    return used


# ---------------------------------------------------------------------------------------------- the plan
@dataclass
class Plan:
    """Runs of the large items. Ranks count large items from the largest, over all sizes."""

    capacity: int
    #: size -> rank of its first item
    first: dict[int, int] = field(default_factory=dict)
    #: start rank, rank in its group's places, items per container, first container
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    per: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    container: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    containers: int = 0

    def large(self, rank: np.ndarray) -> np.ndarray:
        """Container of each large item by its rank."""
        r = np.searchsorted(self.starts, rank, side="right") - 1
        return self.container[r] + (rank - self.starts[r]) // self.per[r]


def plan_large(histogram: dict[int, int], capacity: int, groups: int = GROUPS, small: float = SMALL) -> Plan:
    """Linear grouping and configurations for the sizes over ``small`` of the capacity."""
    sizes = sorted((s for s in histogram if s > small * capacity), reverse=True)
    plan, at = Plan(capacity), 0
    for s in sizes:
        plan.first[s] = at
        at += histogram[s]
    if not at:
        return plan
    edges = sorted({round(i * at / groups) for i in range(groups + 1)})
    firsts = np.array([plan.first[s] for s in sizes])
    rounded = [int(sizes[np.searchsorted(firsts, e, side="right") - 1]) for e in edges[:-1]]
    # groups of one rounded size are one group
    bounds: list[list[int]] = []
    for s, a, b in zip(rounded, edges[:-1], edges[1:], strict=True):
        if bounds and bounds[-1][0] == s:
            bounds[-1][2] = b
        else:
            bounds.append([s, a, b])
    gs = np.array([b[0] for b in bounds], np.int64)
    counts = np.array([b[2] - b[1] for b in bounds], np.int64)
    used = configurations(gs, counts, capacity)
    runs, next_rank, box = [], [b[1] for b in bounds], 0
    for col, times in used:
        for g in np.flatnonzero(col):
            runs.append((next_rank[g], int(col[g]), box))
            next_rank[g] += int(col[g]) * times
        box += times
    runs.sort()
    plan.starts, plan.per, plan.container = (np.array(x, np.int64) for x in zip(*runs, strict=True))
    plan.containers = box
    return plan


@dataclass
class Fill:
    """Runs of the small items: (size, first rank, length, free space class, first rank in class)."""

    runs: list[tuple[int, int, int, int, int]]
    opened: int


def plan_small(small: dict[int, int], free: dict[int, int], capacity: int) -> Fill:
    """Best fit of the ``small`` histogram into containers whose free space has the histogram ``free``.

    Containers of one free space are a class; a class holds intervals of ranks that are still alike. New
    containers are the class ``-1``.
    """
    spaces: list[int] = []
    held: dict[int, list[tuple[int, int, int]]] = {}  # space -> (class, first rank, containers)

    def put(space: int, cls: int, a: int, n: int) -> None:
        if space <= 0 or n <= 0:
            return
        if space not in held:
            insort(spaces, space)
            held[space] = []
        held[space].append((cls, a, n))

    for space, n in free.items():
        put(space, space, 0, n)
    runs, opened = [], 0
    for size in sorted(small, reverse=True):
        rank, left = 0, small[size]
        while left:
            i = bisect_left(spaces, size)
            if i == len(spaces):
                n = -(-left // max(capacity // size, 1))
                put(capacity, -1, opened, n)
                opened += n
                continue
            space = spaces[i]
            cls, a, n = held[space].pop()
            if not held[space]:
                del held[space]
                spaces.pop(i)
            m = min(n, left)
            runs.append((size, rank, m, cls, a))
            put(space - size, cls, a, m)
            put(space, cls, a + m, n - m)
            rank, left = rank + m, left - m
    return Fill(runs, opened)


# --------------------------------------------------------------------------------------------- over Spark
def _ranked(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``rank``: 0, 1, .. among rows of equal ``keys``.

    Rows count within their partition; a running sum over (keys, partition) adds what earlier partitions
    hold. ``df`` must be materialised, so that its partitions are the same in both readings.
    """
    names = [f.name for f in df.schema]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for b in batches:
            if not len(b):
                continue
            g = b.groupby(keys, sort=False)
            rank = g.cumcount().to_numpy(np.int64)
            code = g.ngroup().to_numpy()
            first = np.unique(code, return_index=True)[1]
            ids = list(b[keys].iloc[first].itertuples(index=False, name=None))
            rank += np.array([seen.get(k, 0) for k in ids], np.int64)[code]
            for k, n in zip(ids, np.bincount(code), strict=True):
                seen[k] = seen.get(k, 0) + int(n)
            yield b.assign(local=rank)

    # the number of a task isn't that of the partition where tables are put together, so the column is made here
    counted = df.withColumn("pid", F.spark_partition_id()).mapInPandas(local, types + ", pid int, local long")
    sums = counted.groupBy(*keys, "pid").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "pid", F.coalesce("before", F.lit(0)).alias("before"))
    return counted.join(before, [*keys, "pid"]).select(*names, (F.col("local") + F.col("before")).alias("rank"))


def _histograms(df: DataFrame, size: str) -> dict[int, dict[int, int]]:
    """capacity -> size -> rows; at most the sum of the capacities rows reach the driver."""
    out: dict[int, dict[int, int]] = {}
    for r in df.groupBy("capacity", size).agg(F.count("*").alias("n")).collect():
        out.setdefault(r["capacity"], {})[r[size]] = r["n"]
    return out


def pieces(sized: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity, doc_id, piece_no, start_token, size): whole items, or full pieces and a rest where an item exceeds the capacity."""
    caps = F.explode(F.array(*[F.lit(int(c)) for c in sorted(set(capacities))]))
    each = sized.where("n_tokens > 0").select("doc_id", "n_tokens", caps.alias("capacity"))
    last = F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("int")
    cut = each.select("capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    start = F.col("piece_no") * F.col("capacity").cast("long")
    return cut.select("capacity", "doc_id", "piece_no", start.alias("start_token"), F.least(F.col("capacity").cast("long"), F.col("n_tokens") - start).cast("int").alias("size"))


def packed(sized: DataFrame, capacities: list[int], groups: int = GROUPS, small: float = SMALL) -> DataFrame:
    """(capacity, container_id, doc_id, piece_no, start_token, size): every piece of every item, for each capacity.

    ``sized``: (doc_id, n_tokens). Items of size 0 have one row with container_id null.
    """
    sized = settle(sized.select("doc_id", "n_tokens"))
    whole_or_cut = pieces(sized, capacities)  # row by row from a checkpoint, so its partitions stay the same
    items = _ranked(whole_or_cut, ["capacity", "size"])
    histogram = _histograms(whole_or_cut, "size")
    plans = {c: plan_large({s: n for s, n in h.items() if s < c}, c, groups, small) for c, h in histogram.items()}
    full = {c: h.get(c, 0) for c, h in histogram.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            box = np.full(len(b), -1, np.int64)
            cap, size, rank = b.capacity.to_numpy(), b["size"].to_numpy(), b["rank"].to_numpy()
            for c in np.unique(cap):
                plan, here = plans[int(c)], cap == c
                whole = here & (size == c)
                box[whole] = rank[whole]
                some = np.flatnonzero(here & (size < c) & (size > small * c))
                if len(some):
                    box[some] = full[int(c)] + plan.large(np.array([plan.first[s] for s in size[some]], np.int64) + rank[some])
            yield b.assign(container_id=box)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    placed = settle(items.mapInPandas(place, types + ", container_id long"))
    fixed = placed.where("container_id >= 0")
    # free space of the containers that hold large items; full ones have none
    partial = fixed.where("size < capacity").groupBy("capacity", "container_id").agg((F.first("capacity") - F.sum("size")).cast("int").alias("free")).where("free > 0")
    partial = settle(partial)
    boxes = _ranked(partial, ["capacity", "free"])
    spaces = _histograms(partial, "free")
    fills = {c: plan_small({s: n for s, n in h.items() if s < c and s <= small * c}, spaces.get(c, {}), c) for c, h in histogram.items()}
    first_new = {c: full[c] + plans[c].containers for c in plans}
    lookup = {}
    for c, f in fills.items():
        by: dict[int, list[tuple[int, int, int]]] = {}
        for size, rank, _, cls, a in f.runs:
            by.setdefault(size, []).append((rank, cls, a))
        lookup[c] = {s: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for s, v in by.items()}
    runs = sized.sparkSession.sparkContext.broadcast(lookup)  # as long as the plan, which the capacities bound

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cls, pos = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for (c, s), g in b.groupby(["capacity", "size"]).indices.items():
                ranks, classes, firsts = runs.value[int(c)][int(s)]
                r = b["rank"].to_numpy()[g]
                k = np.searchsorted(ranks, r, side="right") - 1
                cls[g], pos[g] = classes[k], firsts[k] + r - ranks[k]
            yield b.drop(columns=["container_id", "rank"]).assign(free=cls.astype(np.int32), at=pos)

    short = "capacity int, doc_id long, piece_no int, start_token long, size int"
    little = placed.where("container_id < 0").select("capacity", "doc_id", "piece_no", "start_token", "size", "rank", "container_id").mapInPandas(fill, short + ", free int, at long")
    bases = F.create_map(*[x for c in sorted(first_new) for x in (F.lit(c), F.lit(int(first_new[c])))]) if first_new else None
    opened = little.where("free = -1").select("capacity", (bases[F.col("capacity")] + F.col("at")).alias("container_id"), "doc_id", "piece_no", "start_token", "size") if first_new else None
    into = little.where("free >= 0").join(boxes.withColumnRenamed("rank", "at"), ["capacity", "free", "at"])
    cols = ["capacity", "container_id", "doc_id", "piece_no", "start_token", "size"]
    none = sized.where("n_tokens = 0").select(F.explode(F.array(*[F.lit(int(c)) for c in sorted(set(capacities))])).alias("capacity"), F.lit(None).cast("long").alias("container_id"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("start_token"), F.lit(0).alias("size"))
    out = fixed.select(*cols).unionByName(into.select(*cols))
    if opened is not None:
        out = out.unionByName(opened)
    return out.unionByName(none)


def report(pack: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, share of the space filled, and the least number of containers possible."""
    per = pack.where("container_id is not null").groupBy("capacity", "container_id").agg(F.sum("size").alias("t"))
    return per.groupBy("capacity").agg(
        F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.ceil(F.sum("t") / F.first("capacity")).alias("least_containers"), (F.sum("t") / (F.count("*") * F.first("capacity"))).alias("fill_rate"), F.max("t").alias("fullest")
    )
