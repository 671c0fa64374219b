"""Packing of items into containers of fixed capacity by the sum-of-squares rule.

Items come one by one. With N(h) the number of open containers filled to level h, each item is put where the
sum of the squares of N becomes least: into a new container, or on top of a level that has one. The choice
needs only the level array, so it takes one vector operation an item whatever was packed before.

Shards of items are packed side by side, without text: only ids and sizes move. What each shard leaves open is
packed once more in the same way, whole containers now being the items, until little is open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Items that one task packs.
SHARD_ITEMS = 25_000
#: Containers less full than this share are packed again with those of other shards.
FULL = 0.97
#: A further round is made while the last one took away at least this share of the open containers.
PROGRESS = 0.05


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container, offset) of each item, in order; sizes from 1 to capacity.

    Ties go to the fullest level, so a container that the item fills up is taken first.
    """
    levels = np.zeros(capacity + 1, np.int64)  # open containers by level; 0 and capacity stay empty
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    box, offset, made = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        # change of the sum when a container goes from level h to h + s: (N(h)-1)^2 - N(h)^2 + (N(h+s)+1)^2 - N(h+s)^2
        gain = 2 * levels[s:].copy() + 1
        gain[-1] = 0  # a full container is closed and counts no more
        gain[1:] += 1 - 2 * levels[1 : capacity - s + 1]
        gain[1:][levels[1 : capacity - s + 1] == 0] = np.iinfo(np.int64).max
        h = len(gain) - 1 - int(np.argmin(gain[::-1]))
        if h == 0:
            b, made = made, made + 1
        else:
            b = stacks[h].pop()
            levels[h] -= 1
        if h + s < capacity:
            stacks[h + s].append(b)
            levels[h + s] += 1
        box[i], offset[i] = b, h
    return box, offset


def pieces(df: DataFrame, id_col: str, size, capacity: int) -> DataFrame:
    """(id, all, copy, piece, start, size): each item whole, or, only if it exceeds the capacity, in parts of it.

    Rows that agree in id and size are told apart by copy, from 1.
    """
    own = df.select(F.col(id_col).cast("long").alias("id"), size.cast("long").alias("all"))
    counted = own.groupBy("id", "all").agg(F.count(F.lit(1)).alias("n"))
    each = counted.select("id", "all", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    cut = each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("all") / capacity) - 1, F.lit(0)).cast("int"))))
    start = F.col("piece").cast("long") * capacity
    return cut.select("id", "all", "copy", "piece", start.alias("start"), F.least(F.col("all") - start, F.lit(capacity)).alias("size"))


def _pack(capacity: int):
    def run(key, pdf):
        # an order that does not depend on how rows arrived and has no trend in it
        pdf = pdf.sort_values(["order", "box"], ignore_index=True)
        box, offset = sum_of_squares(pdf["size"].to_numpy(np.int64), capacity)
        return pd.DataFrame({"box": pdf["box"], "into": [f"{key[0]}.{key[1]}.{b}" for b in box], "shift": offset, "size": pdf["size"]})

    return run


def _moves(boxes: DataFrame, level: int, shards: int, capacity: int) -> DataFrame:
    """(box, into, shift, size): one round, each shard packed by itself."""
    keyed = boxes.withColumn("order", F.xxhash64("box", F.lit(level)))
    keyed = keyed.withColumn("level", F.lit(level)).withColumn("shard", F.pmod(F.xxhash64("order"), F.lit(shards)))
    return materialise(keyed.groupBy("level", "shard").applyInPandas(_pack(capacity), "box string, into string, shift long, size long"))


def pack(df: DataFrame, id_col: str, size, capacity: int) -> DataFrame:
    """(id, piece, start, size, container, offset): each piece's container and position in it, every item exactly once.

    size: a column of whole numbers; items of size 0 or null are taken as 0 and stand at offset 0 of a container of their
    own kind, "empty". Rows that repeat an id, with another size or the same, are items of their own. Equal sizes keep an
    order by a hash, so the result does not depend on partitions.

    The first round packs the items, the further ones the containers that are still open; a round is made only if
    several shards are left and the last round closed or merged at least PROGRESS of what was open, so their number is
    bounded by its logarithm. Containers that find no partner stay as they are. Items are joined to the containers once,
    at the end; between rounds only the open containers move.
    """
    cut = materialise(pieces(df, id_col, F.coalesce(size, F.lit(0)), capacity))
    real = cut.filter("size > 0")
    name = F.concat_ws(".", "id", "all", "copy", "piece")
    full = real.filter(F.col("size") == capacity).select("id", "piece", "start", "size", F.concat(F.lit("full."), name).alias("container"), F.lit(0).cast("long").alias("offset"))
    rest = real.filter(F.col("size") < capacity).withColumn("box", F.concat(F.lit("i."), name))
    boxes, opened = rest.select("box", "size"), None
    rounds: list[DataFrame] = []
    while True:
        n = boxes.count()
        if n == 0 or (opened is not None and n > (1 - PROGRESS) * opened):
            break
        shards = -(-n // SHARD_ITEMS)
        moved = _moves(boxes, len(rounds), shards, capacity)
        rounds.append(moved)
        if shards == 1:
            break
        opened = n if len(rounds) > 1 else None  # the first round turns items into containers: its number says nothing
        boxes = materialise(moved.groupBy("into").agg(F.sum("size").alias("size")).filter(F.col("size") < FULL * capacity).withColumnRenamed("into", "box"))
    placed = rest.select("id", "piece", "start", "size", F.col("box").alias("container"), F.lit(0).cast("long").alias("offset"))
    if rounds:
        last = rounds[-1].select("box", "into", "shift")
        for earlier in reversed(rounds[:-1]):  # where a round's containers ended up
            onward = last.select(F.col("box").alias("into"), F.col("into").alias("_to"), F.col("shift").alias("_by"))
            last = earlier.select("box", "into", "shift").join(onward, "into", "left").select("box", F.coalesce("_to", "into").alias("into"), (F.col("shift") + F.coalesce("_by", F.lit(0))).alias("shift"))
        placed = rest.join(last, "box").select("id", "piece", "start", "size", F.col("into").alias("container"), F.col("shift").alias("offset"))
    empty = cut.filter("size <= 0").select("id", "piece", "start", "size", F.lit("empty").alias("container"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(placed).unionByName(empty)


def containers(packed: DataFrame, capacity: int) -> DataFrame:
    """(container, pieces, used, unused) of a packing."""
    return packed.filter("size > 0").groupBy("container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("used")).withColumn("unused", F.lit(capacity) - F.col("used"))
