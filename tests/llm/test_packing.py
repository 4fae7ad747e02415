import collections

import pytest

from sievework.llm import packing as K
from sievework.llm import tokens


def _check(rows, pack, capacities):
    whole = dict(rows)
    by = collections.defaultdict(list)
    load = collections.Counter()
    for r in pack:
        by[r["capacity"], r["doc_id"]].append(r)
        if r["container_id"] is not None:
            load[r["capacity"], r["container_id"]] += r["size"]
    assert set(by) == {(c, d) for c in capacities for d in whole}
    for (c, d), parts in by.items():
        parts.sort(key=lambda r: r["piece_no"])
        assert [p["piece_no"] for p in parts] == list(range(len(parts)))
        assert sum(p["size"] for p in parts) == whole[d]
        assert all(p["start_token"] == i * c for i, p in enumerate(parts))
        assert len(parts) == max(1, -(-whole[d] // c))  # split only beyond the capacity
        assert all(p["size"] == c for p in parts[:-1])
        assert (parts[0]["container_id"] is None) == (whole[d] == 0)
    assert all(n <= c for (c, _), n in load.items())
    return {c: len([1 for k in load if k[0] == c]) for c in capacities}


@pytest.mark.parametrize("parts", [1, 5])
def test_every_piece_once_and_no_container_over_its_capacity(spark, parts):
    import random

    r = random.Random(4)
    rows = [(i, r.choice([0, 1, 3, 7, 64, 100, 100, 100, r.randrange(1, 400), r.randrange(1, 90)])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").repartition(parts)
    used = _check(rows, K.packed(df, [64, 256]).collect(), [64, 256])
    for c, n in used.items():
        assert n <= 1.02 * _first_fit(rows, c) + 3


def _first_fit(rows, c):
    """Containers that first fit decreasing needs."""
    rests = sorted((n % c for _, n in rows if n % c), reverse=True)
    space = []
    for s in rests:
        i = next((i for i, f in enumerate(space) if f >= s), None)
        if i is None:
            space.append(c - s)
        else:
            space[i] -= s
    return len(space) + sum(n // c for _, n in rows)


def test_small_inputs(spark):
    schema = "doc_id long, n_tokens long"
    for rows in ([], [(1, 0)], [(1, 5)], [(1, 640)], [(1, 641), (2, 3)], [(i, 30) for i in range(7)]):
        _check(rows, K.packed(spark.createDataFrame(rows, schema), [64]).collect(), [64])


def test_configurations_hold_every_item():
    import numpy as np

    sizes, counts = np.array([70, 50, 31, 24]), np.array([101, 57, 203, 90])
    used = K.configurations(sizes, counts, 100)
    assert (sum(col * t for col, t in used) == counts).all() and all((col * sizes).sum() <= 100 for col, _ in used)
    # 70s only go with 24s, two 50s and three 31s fill a container each
    assert sum(t for _, t in used) == 101 + 29 + 68


def test_best_fit_uses_free_space_first():
    fill = K.plan_small({5: 3, 2: 1}, {5: 1, 9: 1}, 10)
    assert fill.opened == 1 and sum(m for _, _, m, _, _ in fill.runs) == 4


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.sized(df, "id", "text").collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1  # special strings are ordinary text
