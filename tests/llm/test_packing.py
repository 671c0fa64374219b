import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodepath.llm import packing as P


def check(rows, sizes, capacity):
    """Each item once, whole unless too large; pieces of a container do not overlap."""
    per_item, per_box = {}, {}
    for i, piece, start, size, box, offset in rows:
        per_item.setdefault(i, []).append((piece, start, size))
        if size:
            per_box.setdefault(box, []).append((offset, size))
    assert set(per_item) == set(range(len(sizes)))
    for i, parts in per_item.items():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(s for _, _, s in parts) == (sizes[i] or 0)
        assert len(parts) == max(1, -(-(sizes[i] or 0) // capacity)) and all(a + c == b for (_, a, c), (_, b, _) in zip(parts, parts[1:], strict=False))
    for parts in per_box.values():
        parts.sort()
        assert all(a + s <= b for (a, s), (b, _) in zip(parts, parts[1:], strict=False)) and parts[-1][0] + parts[-1][1] <= capacity
    return len(per_box)


@pytest.mark.parametrize("shard", [P.SHARD_ITEMS, 60])
def test_pack(spark, monkeypatch, shard):
    monkeypatch.setattr(P, "SHARD_ITEMS", shard)
    r = random.Random(2)
    sizes = [r.choice([1, 3, 10, 25, 40, 60, 99, 100, 101, 250]) for _ in range(500)] + [0, None, 100_000]
    df = spark.createDataFrame([(i, s, "b", 1) for i, s in enumerate(sizes)], "doc long, n long, box string, piece int")
    rows = [tuple(x) for x in P.pack(df, "doc", F.col("n"), 100).collect()]
    boxes = check(rows, sizes, 100)
    least = -(-sum(s or 0 for s in sizes) // 100)
    assert boxes <= 1.03 * least + 2
    assert sorted(rows) == sorted(tuple(x) for x in P.pack(df.repartition(7), "doc", F.col("n"), 100).collect())


def test_rounds_end_where_nothing_fits(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ITEMS", 10)
    df = spark.createDataFrame([(i, 60) for i in range(30)], "doc long, n long")
    rows = [tuple(x) for x in P.pack(df, "doc", F.col("n"), 100).collect()]
    assert check(rows, [60] * 30, 100) == 30


def test_rounds_end_with_real_sizes(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ITEMS", 100)
    r = random.Random(4)
    sizes = [int(min(9000, r.lognormvariate(7.3, 0.8))) + 1 for _ in range(1200)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc long, n long")
    boxes = check([tuple(x) for x in P.pack(df, "doc", F.col("n"), 4096).collect()], sizes, 4096)
    assert boxes <= 1.05 * sum(sizes) / 4096 + 2


def test_repeated_ids_are_items_of_their_own(spark):
    df = spark.createDataFrame([(1, 30), (1, 30), (1, 30), (1, 250), (2, 10)], "doc long, n long")
    rows = P.pack(df, "doc", F.col("n"), 100).collect()
    assert sorted((x.id, x.size) for x in rows) == [(1, 30), (1, 30), (1, 30), (1, 50), (1, 100), (1, 100), (2, 10)]
    taken = sorted((x.container, x.offset, x.size) for x in rows)
    assert all(a[0] != b[0] or a[1] + a[2] <= b[1] for a, b in zip(taken, taken[1:], strict=False))


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc long, n long"), "doc", F.col("n"), 10).count() == 0


def test_sum_of_squares_takes_the_least(monkeypatch):
    """Each choice against trying all levels."""
    r = np.random.default_rng(1)
    sizes, capacity = r.integers(1, 13, 300), 12
    box, offset = P.sum_of_squares(sizes, capacity)
    fill, counts = {}, np.zeros(capacity + 1, int)
    for b, h, s in zip(box, offset, sizes, strict=True):
        costs = {}
        for level in range(capacity - s + 1):
            if level and not counts[level]:
                continue
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + s < capacity:
                c[level + s] += 1
            costs[level] = int((c[1:capacity] ** 2).sum())
        assert fill.get(b, 0) == h and costs[h] == min(costs.values())
        if h:
            counts[h] -= 1
        fill[b] = h + s
        if h + s < capacity:
            counts[h + s] += 1
