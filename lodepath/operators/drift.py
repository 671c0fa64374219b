"""Schemas that drift between files: what changed from file to file, and one consistent table.

Records are loaded as rows of (path, raw types, comparable value); statistics by file and path are
aggregated from these; changes are read from the statistics of consecutive files; and typed columns are
projected with a report of every cast that failed.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsontext import canonical, comparable, parse_exact, types
from ..session import materialise, small_join, spread
from .components import components


def path_values(text: str | None, parents: list[str]) -> list[tuple[str, str, list[str], str | None, str]] | None:
    """(path, level, types, digest of the comparable value or None for null, JSON text) of each field; None if text is no JSON object.

    Fields are the members of the record and of the objects named in parents, nothing deeper.
    """
    if text is None:
        return None
    try:
        record = parse_exact(text)
    except ValueError:
        return None
    if not isinstance(record, dict):
        return None
    out = []
    for level, members in (("", record), *[(p, record[p]) for p in parents if isinstance(record.get(p), dict)]):
        for name, v in members.items():
            digest = None if v is None else hashlib.blake2b(comparable(v).encode(), digest_size=12).hexdigest()
            out.append((f"{level}.{name}" if level else name, level, sorted(types(v)), digest, canonical(v)))
    return out


_FIELDS = pa.schema(
    [("row", pa.int64()), ("feed", pa.int64()), ("drop", pa.int64()), ("id", pa.string())]
    + [("path", pa.string()), ("level", pa.string()), ("types", pa.list_(pa.string())), ("digest", pa.string()), ("value", pa.string())]
)


def _load(parents: list[str], id_field: str, values: bool):
    def run(batches):
        for batch in batches:
            out = []
            for row, feed, drop, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fields = path_values(text, parents)
                if not fields:  # so that the record counts: level tells an object without fields from what is none
                    out.append((row, feed, drop, None, None, None if fields is None else "", None, None, None))
                    continue
                key = next((f[4] for f in fields if f[0] == id_field and f[3] is not None), None)
                out += [(row, feed, drop, key, p, lv, t, g, v if values else None) for p, lv, t, g, v in fields]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _FIELDS.types, strict=True)], schema=_FIELDS)

    return run


def load_fields(df: DataFrame, row: str, feed: str, drop: str, text: str, parents: list[str], id_field: str = "id", values: bool = False) -> DataFrame:
    """(row, feed, drop, id, path, level, types, digest[, value]) of each field of each record.

    A record that is no JSON object, or null, gives one row with null path and level, and an object without fields one with
    a null path and an empty level, so that both are counted. A name that is
    repeated within an object counts with its last value. Extra columns of df are not read.
    """
    raw = df.select(F.col(row).cast("long").alias("row"), F.col(feed).cast("long").alias("feed"), F.col(drop).cast("long").alias("drop"), F.col(text).cast("string").alias("text"))
    kinds = "row long, feed long, drop long, id string, path string, level string, types array<string>, digest string, value string"
    out = spread(raw).mapInArrow(_load(parents, id_field, values), kinds)
    return out if values else out.drop("value")


def path_statistics(fields: DataFrame) -> DataFrame:
    """(feed, drop, path, level, records, nulls, types): one row for each field of each file, partially aggregated before the shuffle."""
    return (
        fields.filter("path is not null")
        .groupBy("feed", "drop", "path", "level")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count_if(F.col("digest").isNull()).alias("nulls"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"),
        )
    )


def changes(fields: DataFrame) -> DataFrame:
    """(feed, drop, change, field_path, new_path): each file against the previous file of its feed.

    fields: from load_fields(), materialised (it is read several times). A field that is gone is renamed to one that
    is new at the same level if both have equal values (absent equals null) in all records found, by id, in both
    files, not all null; with several such partners there is one row for each. Numbers are equal if type and value are.
    Records without an id take no part in that comparison; an id that stands several times in a file must agree in all
    its values. Empty tables and the first file of a feed have no changes.

    Values are not compared one by one: each gone or new field gets one digest of its (id, value) pairs, a count, a sum
    and an exclusive or of 64-bit hashes, partially aggregated, and fields with equal digests are partners.
    """
    stats = materialise(path_statistics(fields))
    files = fields.select("feed", "drop").distinct()
    steps = materialise(files.withColumn("before", F.lag("drop").over(Window.partitionBy("feed").orderBy("drop"))).filter("before is not null"))
    now = steps.join(stats, ["feed", "drop"]).select("feed", "drop", "before", "path", "level", "types", F.lit(None).cast("array<string>").alias("old_types"))
    old = steps.join(stats.withColumnRenamed("drop", "before"), ["feed", "before"]).select("feed", "drop", "before", "path", "level", F.lit(None).cast("array<string>").alias("types"), F.col("types").alias("old_types"))
    both = materialise(now.unionByName(old).groupBy("feed", "drop", "before", "path", "level").agg(F.max("types").alias("types"), F.max("old_types").alias("old_types")))
    gone = both.filter("types is null").select("feed", "drop", F.col("before").alias("at"), "path", "level", F.lit(True).alias("gone"))
    new = both.filter("old_types is null").select("feed", "drop", F.col("drop").alias("at"), "path", "level", F.lit(False).alias("gone"))
    moved = gone.unionByName(new)
    # ids that stand in both files of a step: hot feeds spread by id
    known = fields.filter("id is not null").select("feed", F.col("drop").alias("at"), "id").distinct()
    later = known.join(steps.withColumn("at", F.col("drop")), ["feed", "at"]).select("feed", "drop", "id", F.lit(1).alias("side"))
    earlier = known.join(steps.withColumn("at", F.col("before")), ["feed", "at"]).select("feed", "drop", "id", F.lit(2).alias("side"))
    common = later.unionByName(earlier).groupBy("feed", "drop", "id").agg(F.sum("side").alias("sides")).filter("sides = 3").select("feed", "drop", "id")
    # non-null values of gone and new fields only
    values = fields.filter("path is not null and digest is not null and id is not null").select("feed", F.col("drop").alias("at"), "id", "path", "digest")
    kept = small_join(values, moved, ["feed", "at", "path"]).join(common, ["feed", "drop", "id"], "left_semi").distinct()
    pair = F.xxhash64("id", "digest")
    whole = kept.groupBy("feed", "drop", "level", "gone", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(pair.cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64("digest", F.lit(1), "id")).alias("mixed"))
    whole = materialise(whole)
    key = ["feed", "drop", "level", "n", "total", "mixed"]
    renamed = materialise(whole.filter("gone").withColumnRenamed("path", "old").join(whole.filter("not gone").withColumnRenamed("path", "new"), key).select("feed", "drop", "old", "new"))

    def report(of: DataFrame, change: str, field: str, to: str | None = None) -> DataFrame:
        return of.select("feed", "drop", F.lit(change).alias("change"), F.col(field).alias("field_path"), (F.col(to) if to else F.lit("")).alias("new_path"))

    left = gone.join(renamed.select("feed", "drop", F.col("old").alias("path")), ["feed", "drop", "path"], "left_anti")
    came = new.join(renamed.select("feed", "drop", F.col("new").alias("path")), ["feed", "drop", "path"], "left_anti")
    typed = both.filter("types is not null and old_types is not null and types <> old_types")
    return report(typed, "type_changed", "path").unionByName(report(left, "removed", "path")).unionByName(report(came, "added", "path")).unionByName(report(renamed, "renamed", "old", "new"))


def unified_names(found: DataFrame) -> DataFrame:
    """(path, name): for each path that a rename touches, the one name of its group: the path that is renamed away most often, then the first by name.

    found: from changes(). Renames are counted over all feeds and files; groups are the connected components of the
    renames, found by joins, so names may be as many as they like.
    """
    edges = materialise(found.filter("change = 'renamed'").groupBy(F.col("field_path").alias("a"), F.col("new_path").alias("b")).agg(F.count(F.lit(1)).alias("n")))
    weight = edges.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("weight"))
    named = components(edges).join(weight, "id", "left")
    best = named.groupBy("component").agg(F.min_by("id", F.struct(-F.coalesce("weight", F.lit(0)), "id")).alias("name"))
    return materialise(named.join(best, "component").select(F.col("id").alias("path"), "name"))


def consistent(fields: DataFrame, names: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row for each record: row, feed, drop, the named columns typed, the other fields as a map of JSON text, and failed casts.

    fields: from load_fields(values=True). names: from unified_names(). columns: path -> type. A value that its type
    does not take is null in its column and stands, with its text, in failed_casts. If a record holds both the old and
    the new name of a field, the non-null value of the unified name's own path counts first.
    """
    raw = F.when(F.col("value") != "null", F.when(F.col("value").startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")).otherwise(F.col("value")))
    to = F.coalesce("name", "path")
    one = small_join(fields, names, ["path"], "left")
    one = one.select("row", "feed", "drop", "level", to.alias("to"), F.struct((F.col("path") != to).alias("moved"), raw.alias("raw"), "value").alias("v"), raw.alias("raw"))
    rows = one.groupBy("row", "feed", "drop").agg(
        *[F.min(F.when((F.col("to") == p) & F.col("raw").isNotNull(), F.col("v"))).alias(f"_{i}") for i, p in enumerate(columns)],
        F.map_from_entries(F.array_distinct(F.collect_list(F.when(~F.coalesce(F.col("to").isin(list(columns)), F.lit(False)) & F.col("to").isNotNull(), F.struct("to", "v.value"))))).alias("other_fields"),
        F.count_if(F.col("to").isNull() & F.col("level").isNull()).alias("unreadable"),
    )
    cast = {p: F.col(f"_{i}.raw").try_cast(t) for i, (p, t) in enumerate(columns.items())}
    failed = [F.when(F.col(f"_{i}").isNotNull() & cast[p].isNull(), F.struct(F.lit(p).alias("path"), F.col(f"_{i}.raw").alias("text"))) for i, p in enumerate(columns)]
    return rows.select("row", "feed", "drop", *[cast[p].alias(p.replace(".", "_")) for p in columns], "other_fields", (F.col("unreadable") > 0).alias("unreadable"), F.filter(F.array(*failed), lambda x: x.isNotNull()).alias("failed_casts"))
