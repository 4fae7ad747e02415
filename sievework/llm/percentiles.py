"""Percentiles of very large numeric columns by merging centroid digests.

A digest is a set of centroids (mean, weight, least, greatest) of sorted values. Values share a centroid as
long as it lies within one unit of the size function k(q) = (compression / 2 pi) * asin(2q - 1), so that
centroids are small at the ends and a few thousandths of all rows in the middle. Every task digests its rows
per finest group and merges these digests into those of the coarser groups that are asked for; digests of one
group are merged by sorting their centroids and clustering again. All groups of a task are clustered at once,
by array operations. Merging between tasks is done in two levels, so that no task receives the digests of all
tasks. A centroid is a row of plain columns: digests can be written per day and merged later (``combine``).

A second pass counts, for each group and wanted percentile, how many values lie below and up to the answer,
so that each row of the result states its certified error in rank.

Defined cases: null, NaN and infinite values are counted as ``n_invalid`` and take no part; values outside
the bounds given for the column likewise. A null group is a group. An empty table gives no rows. A group
without a valid value has null percentiles.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.sources.shared import settle

COMPRESSION = 400
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)
#: digests of one group are first merged in this many parts
FAN_IN = 32
#: centroids and values a task holds before it clusters them, and that it holds at most after that
HELD = 1 << 20
#: columns of a centroid; in a row without a mean the weight is a number of invalid values
CENTROID = ["mean", "weight", "least", "greatest"]
Digest = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Values = Mapping[str, tuple[Column, float, float]]


def cluster(code: np.ndarray, d: Digest, compression: float = COMPRESSION) -> tuple[np.ndarray, Digest]:
    """Centroids of every group ``code``, in the order of groups and means.

    Equal values become one centroid first. Then neighbours join that lie within the same unit of k; one
    that reaches into a second unit stays alone.
    """
    if not len(code):
        return code, d
    order = np.lexsort((d[2], d[0], code))
    code, m, w, lo, hi = code[order], *(x[order] for x in d)
    equal = (code[1:] == code[:-1]) & (lo[1:] == hi[:-1]) & (lo[1:] == lo[:-1]) & (hi[1:] == lo[1:])
    s = np.flatnonzero(np.append(True, ~equal))
    code, m, w, lo, hi = code[s], m[s], np.add.reduceat(w, s), lo[s], hi[s]
    other = code[1:] != code[:-1]
    first = np.flatnonzero(np.append(True, other))
    size = np.diff(np.append(first, len(code)))
    end = np.cumsum(w)
    before = np.repeat(end[first] - w[first], size)
    total = np.repeat(np.add.reduceat(w, first), size)
    unit = lambda rank: compression / (2 * np.pi) * np.arcsin(np.clip(2 * rank / total - 1, -1, 1))
    left, right = np.floor(unit(end - w - before) + 1e-9), np.ceil(unit(end - before) - 1e-9) - 1
    whole = left >= right
    s = np.flatnonzero(np.append(True, other | (left[1:] != left[:-1]) | ~whole[1:] | ~whole[:-1]))
    weight = np.add.reduceat(w, s)
    return code[s], (np.add.reduceat(m * w, s) / weight, weight, np.minimum.reduceat(lo, s), np.maximum.reduceat(hi, s))


def digest(values: np.ndarray, compression: float = COMPRESSION) -> Digest:
    """Digest of finite ``values``."""
    v = np.asarray(values, float)
    return cluster(np.zeros(len(v), int), (v, np.ones(len(v)), v, v), compression)[1]


def merged(parts: Sequence[Digest], compression: float = COMPRESSION) -> Digest:
    """One digest of several, by clustering their centroids again."""
    if not parts:
        return (np.zeros(0),) * 4
    together = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return cluster(np.zeros(len(together[0]), int), together, compression)[1]


def quantile(d: Digest, q: Sequence[float]) -> np.ndarray:
    """Values at ranks ``q``: each centroid spreads its weight evenly from its least to its greatest value.

    A heap of equal values is a centroid without spread, so ranks inside it have exactly its value.
    """
    means, weights, mins, maxs = d
    if not len(means):
        return np.full(len(q), np.nan)
    end = np.cumsum(weights)
    x = np.stack([end - weights, end], 1).ravel()
    y = np.maximum.accumulate(np.stack([mins, maxs], 1).ravel())
    return np.interp(np.asarray(q) * end[-1], x, y)


Sets = Mapping[str, Sequence[str]]


class Held:
    """Digests of many groups in one task; groups are numbered as they come."""

    def __init__(self, keys: Sequence[str], compression: float):
        self.keys, self.compression = list(keys), compression
        self.clear()

    def clear(self) -> None:
        self.number: dict[tuple, int] = {}
        self.codes: list[np.ndarray] = []
        self.parts: list[Digest] = []
        self.size = 0
        self.invalid = np.zeros(0)

    def numbers(self, keys: list[tuple]) -> np.ndarray:
        """The numbers of ``keys``, new ones included."""
        got = np.array([self.number.setdefault(k, len(self.number)) for k in keys], int)
        if len(self.number) > len(self.invalid):
            self.invalid = np.append(self.invalid, np.zeros(2 * len(self.number) - len(self.invalid)))
        return got

    def add(self, codes: np.ndarray, d: Digest) -> None:
        self.codes.append(codes), self.parts.append(d)
        self.size += len(codes)
        if self.size > HELD:
            self.squeeze()

    def squeeze(self) -> tuple[np.ndarray, Digest]:
        codes, d = (np.concatenate(self.codes), tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))) if self.codes else (np.zeros(0, int), (np.zeros(0),) * 4)
        codes, d = cluster(codes, d, self.compression)
        self.codes, self.parts, self.size = [codes], [d], len(codes)
        return codes, d

    def full(self) -> bool:
        """Whether clustering no longer helps: there are too many groups to hold."""
        return self.size > HELD // 2 and len(self.codes) == 1

    def rolled(self, sets: Sets, groups: Sequence[str]) -> Held:
        """Digests of coarser groups; the keys held are ``groups`` and one more, those made have the name of the set before them."""
        codes, d = self.squeeze()
        out = Held(["grouping", *self.keys], self.compression)
        for name, kept in sets.items():
            into = out.numbers([(name, *[x if g in kept else None for g, x in zip(groups, key, strict=False)], key[-1]) for key in self.number])
            np.add.at(out.invalid, into, self.invalid[: len(into)])
            out.add(into[codes], d)
        self.clear()
        return out

    def rows(self) -> pd.DataFrame:
        """A row per centroid, and one with the invalid values of each group that has any; empties the holder."""
        codes, d = self.squeeze()
        bad = np.flatnonzero(self.invalid)
        codes, none = np.append(codes, bad), np.full(len(bad), np.nan)
        out = self._named(codes)
        for c, x, y in zip(CENTROID, d, (none, self.invalid[bad], none, none), strict=True):
            out[c] = np.append(x, y)
        self.clear()
        return out

    def estimates(self, quantiles: Sequence[float]) -> pd.DataFrame:
        """A row per group with its numbers of values and its percentiles; empties the holder."""
        codes, d = self.squeeze()
        groups = np.arange(len(self.number))
        cuts = np.searchsorted(codes, np.append(groups, len(groups)))
        out = self._named(groups)
        out["n"] = np.bincount(codes, d[1], len(groups)).astype(np.int64)
        out["n_invalid"] = self.invalid[: len(groups)].astype(np.int64)
        out["est"] = pd.Series([quantile(tuple(x[i:j] for x in d), quantiles) if i < j else None for i, j in zip(cuts[:-1], cuts[1:], strict=True)], dtype=object)
        self.clear()
        return out

    def _named(self, codes: np.ndarray) -> pd.DataFrame:
        names = list(self.number)
        column = lambda i: np.fromiter((k[i] for k in names), object, len(names))
        return pd.DataFrame({k: column(i)[codes] for i, k in enumerate(self.keys)}, index=range(len(codes)))

    def put(self, b: pd.DataFrame) -> tuple:
        """Adds rows of centroids; returns the key of the last."""
        code, known = _runs(b, self.keys)
        numbers = self.numbers(known)[code]
        d = tuple(b[c].to_numpy(float) for c in CENTROID)
        good = ~np.isnan(d[0])
        np.add.at(self.invalid, numbers[~good], d[1][~good])
        self.add(numbers[good], tuple(x[good] for x in d))
        return known[code[-1]]

    def keep(self, key: tuple) -> Held:
        """Takes out all groups but ``key``."""
        codes, d = self.squeeze()
        mine, at = codes == (k := self.number[key]), self.invalid[self.number[key]]
        done = Held(self.keys, self.compression)
        if len(self.number) > 1:
            names = [x for x in self.number if x != key]
            into = done.numbers(names)
            done.invalid[: len(into)] = np.delete(self.invalid[: len(self.number)], k)
            done.add(codes[~mine] - (codes[~mine] > k), tuple(x[~mine] for x in d))
        self.clear()
        self.numbers([key])
        self.invalid[0] = at
        self.add(np.zeros(int(mine.sum()), int), tuple(x[mine] for x in d))
        return done


def _grouped(df: DataFrame, groups: Mapping[str, Column | str], values: Values) -> DataFrame:
    """(g_<group>.. as strings, v_<metric>..)."""
    cols = [(F.col(c) if isinstance(c, str) else c).cast("string").alias(f"g_{g}") for g, c in groups.items()]
    return df.select(*cols, *[c.cast("double").alias(f"v_{k}") for k, (c, _, _) in values.items()])


def _runs(b: pd.DataFrame, names: Sequence[str]) -> tuple[np.ndarray, list[tuple]]:
    """Code of each row by its values of ``names``, and the values of each code; null is a value."""
    code, tables = np.zeros(len(b), np.int64), []
    for n in names:
        c, u = pd.factorize(b[n])
        u = np.append(np.array([None], object), np.asarray(u, object))
        # codes stay small, whatever the number of columns
        distinct, code = np.unique(code * len(u) + c + 1, return_inverse=True)
        tables = [*(t[distinct // len(u)] for t in tables), u[distinct % len(u)]]
    return code, list(zip(*tables, strict=True)) if names else [()]


def _schema(keys: Sequence[str], estimates: bool = False) -> str:
    return "".join(f"{k} string, " for k in keys) + ("n long, n_invalid long, est array<double>" if estimates else ", ".join(f"{c} double" for c in CENTROID))


def _keys(groups: Mapping[str, Column | str]) -> list[str]:
    return ["grouping", *[f"g_{g}" for g in groups], "metric"]


def _parts(df: DataFrame, groups: Mapping[str, Column | str], values: Values, sets: Sets, compression: float) -> DataFrame:
    """What each task has of the digests of every group."""
    names = [f"g_{g}" for g in groups]
    bounds = {k: (lo, hi) for k, (_, lo, hi) in values.items()}
    order = list(groups)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Held([*names, "metric"], compression)
        for b in batches:
            if not len(b):
                continue
            code, keys = _runs(b, names)
            for k, (lo, hi) in bounds.items():
                numbers = held.numbers([(*key, k) for key in keys])
                v = b[f"v_{k}"].to_numpy(float)
                with np.errstate(invalid="ignore"):
                    good = np.isfinite(v) & (v >= lo) & (v <= hi)
                held.invalid[numbers] += np.bincount(code[~good], minlength=len(keys))
                x = v[good]
                held.add(numbers[code[good]], (x, np.ones(len(x)), x, x))
            if held.full():
                yield held.rolled(sets, order).rows()
        yield held.rolled(sets, order).rows()

    return _grouped(df, groups, values).mapInPandas(local, _schema(_keys(groups)))


def digests(df: DataFrame, groups: Mapping[str, Column | str], values: Values, sets: Sets | None = None, compression: float = COMPRESSION) -> DataFrame:
    """The centroids of every group and metric: (grouping, g_<group>.., metric, mean, weight, least, greatest).

    ``values``: metric name to (column, least valid value, greatest valid value). ``sets``: name of a
    grouping to the groups it keeps, the others are null in its rows; by default one, ``all``, that keeps
    every group. Rows are digested once, by the finest groups.
    """
    return _together(_parts(df, groups, values, sets or {"all": tuple(groups)}, compression), _keys(groups), compression)


def combine(parts: DataFrame, keys: Sequence[str], compression: float = COMPRESSION) -> DataFrame:
    """Digests of ``parts`` merged per ``keys``: from partitions, days or any finer group.

    What a task has of a group is merged before it is sent.
    """
    return _together(_merged_here(parts, keys, compression), keys, compression)


def estimates(parts: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = QUANTILES, compression: float = COMPRESSION) -> DataFrame:
    """``combine``, and of each digest one row: (keys.., n, n_invalid, est), the values at ``quantiles`` in their order."""
    return _together(_merged_here(parts, keys, compression), keys, compression, list(quantiles))


def _merged_here(parts: DataFrame, keys: Sequence[str], compression: float) -> DataFrame:
    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Held(keys, compression)
        for b in batches:
            if len(b):
                held.put(b)
                if held.full():
                    yield held.rows()
        yield held.rows()

    return parts.select(*keys, *CENTROID).mapInPandas(local, _schema(keys))


def _together(parts: DataFrame, keys: Sequence[str], compression: float, quantiles: list[float] | None = None) -> DataFrame:
    """The digests of groups from what tasks made of them: first those of a share of the tasks, then all.

    Where at most FAN_IN tasks made them, the second step alone does.
    """
    if parts.rdd.getNumPartitions() > FAN_IN:
        parts = _merge(parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).cast("string")), [*keys, "salt"], compression).drop("salt")
    return _merge(parts, keys, compression, quantiles)


def _merge(parts: DataFrame, keys: Sequence[str], compression: float, quantiles: list[float] | None = None) -> DataFrame:
    """Digests by ``keys``, or their estimates. Parts of a group follow each other, so a task holds one batch and one group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Held(keys, compression)
        shown = (lambda h: h.rows()) if quantiles is None else (lambda h: h.estimates(quantiles))
        for b in batches:
            if len(b):
                yield shown(held.keep(held.put(b)))  # all groups but the last are complete
        yield shown(held)

    columns = [*keys, *CENTROID]
    near = parts.select(*columns).repartition(*keys).sortWithinPartitions(*keys) if keys else parts.select(*columns).coalesce(1)
    return near.mapInPandas(run, _schema(keys, quantiles is not None))


def _exploded(df: DataFrame, groups: Sequence[str], sets: Sets, *others: str) -> DataFrame:
    """A row per row of ``df`` and grouping, with null in the groups that the grouping leaves out."""
    one = [F.struct(F.lit(name).alias("grouping"), *[(F.col(f"g_{g}") if g in kept else F.lit(None).cast("string")).alias(f"g_{g}") for g in groups]) for name, kept in sets.items()]
    return df.withColumn("set", F.explode(F.array(*one))).select("set.*", *others)


#: groups up to which the estimates are broadcast to the counting pass, about 250 bytes each; beyond, rows
#: and estimates meet by a shuffle in which every group is split into SALTS parts
BROADCAST_GROUPS, SALTS = 100_000, 32


def certified(df: DataFrame, groups: Mapping[str, Column | str], values: Values, sets: Sets | None = None, quantiles: Sequence[float] = QUANTILES, compression: float = COMPRESSION, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """(grouping, <group>.., metric, q, value, n, n_invalid, n_below, n_upto, rank_error): percentiles with certified errors.

    ``values`` and ``sets``: see ``digests``. ``rank_error`` is how far q lies outside the interval of ranks
    that hold ``value``, as a share of n.
    """
    sets, names = sets or {"all": tuple(groups)}, _keys(groups)
    keys = names[:-1]
    est = settle(_together(_parts(df, groups, values, sets, compression), names, compression, list(quantiles)))
    wide = est.groupBy(*keys).agg(*[F.first(F.when(F.col("metric") == k, F.col("est")), ignorenulls=True).alias(f"e_{k}") for k in values])
    few = wide.count() <= broadcast_groups  # a row per group; its size is checked here
    wide = wide.select(*[F.col(k).alias(f"w_{k}") for k in keys], *[f"e_{k}" for k in values])
    rows = _exploded(_grouped(df, groups, values), list(groups), sets, *[f"v_{k}" for k in values])
    on = [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys]
    if few:
        joined = rows.join(F.broadcast(wide), on, "inner")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(*[f"v_{k}" for k in values], F.monotonically_increasing_id()), F.lit(SALTS)))
        joined = rows.join(wide.withColumn("w_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*on, F.col("salt") == F.col("w_salt")], "inner")
    counts = []
    for k, (_, lo, hi) in values.items():
        v = F.when(~F.isnan(f"v_{k}") & F.col(f"v_{k}").between(F.lit(max(lo, -1e308)), F.lit(min(hi, 1e308))), F.col(f"v_{k}"))
        for i in range(len(quantiles)):
            e = F.col(f"e_{k}")[i]
            counts += [F.count_if(v < e).alias(f"b_{k}_{i}"), F.count_if(v <= e).alias(f"u_{k}_{i}")]
    counted = joined.groupBy(*keys).agg(*counts)
    per = [F.struct(F.lit(k).alias("metric"), F.lit(i).alias("i"), F.lit(float(q)).alias("q"), F.col(f"b_{k}_{i}").alias("n_below"), F.col(f"u_{k}_{i}").alias("n_upto")) for k in values for i, q in enumerate(quantiles)]
    long = counted.select(*[F.col(k).alias(f"c_{k}") for k in keys], F.inline(F.array(*per)))
    match = [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in keys] + [long["metric"] == est["metric"]]
    n = F.col("n").cast("double")
    out = est.join(long, match, "inner").withColumn("value", F.col("est")[F.col("i")])
    error = F.greatest(F.lit(0.0), F.col("n_below") / n - F.col("q"), F.col("q") - F.col("n_upto") / n)
    return out.select("grouping", *[F.col(f"g_{g}").alias(g) for g in groups], est["metric"], "q", "value", "n", "n_invalid", "n_below", "n_upto", F.when(F.col("n") > 0, error).alias("rank_error"))
