"""Keyed tables without a MERGE: last row wins, then anti-join and union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_join


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the one that is last in order; ties go to the greatest row.

    max_by is partially aggregated, so copies of a hot key collapse before the shuffle. Null keys form one group.
    """
    rest = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest)))
    return rows.groupBy(*key).agg(last.alias("_r")).select(*[F.col(c) if c in key else F.col(f"_r.{c}") for c in rows.columns])


def upsert(base: DataFrame, delta: DataFrame, key: list[str], order: list[str], stale: DataFrame | None = None) -> DataFrame:
    """base with the rows of delta in place of those with an equal key, and without the keys of stale that delta does not hold.

    A small delta is broadcast; a large one makes a shuffle join. Either side may be empty.
    """
    fresh = last_wins(delta, key, order)
    gone = fresh.select(*key)
    if stale is not None:
        gone = gone.unionByName(stale.select(*key)).distinct()
    return small_join(base, gone, key, "left_anti").select(*base.columns).unionByName(fresh.select(*base.columns))
