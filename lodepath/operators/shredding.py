"""Columnar shredding of nested JSON records into level columns, and flat tables rebuilt from them.

A record becomes one level column for each path that occurs in it. A column holds, for each entry,
a repetition level (which array on the path has begun a new element; 0 begins the record) and a
definition level (how far the path is there). The entries of a path are enough to place each value:
tables are rebuilt for each repeated ancestor by counting through the levels.

Steps of a column's path are (name, kind): kind ARRAY for an array (name "" for an array that is
itself an element), LONE for an object that stands in a field on its own, LEAF for a scalar field.
A LONE step adds one definition level (the object is there); an ARRAY step three (the array is
there, it has an element, the element is not null) and one repetition level; a LEAF one (not null).

Whether a lone object counts as an array of one is a property of the whole table: it does if the
same field, whatever the positions above it, holds an array with an object in any row. So paths are
first emitted with LONE marked, and resolved against the repeated fields of all rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import Number, parse_exact, unwrap
from ..session import materialise, small_join, spread

ARRAY, LONE, LEAF = "[]", "{}", ""
#: Marks, within emitted paths, that the step before is a lone object. A record separator: no name holds it.
MARK = "\x1e"
_GONE = object()

Step = tuple[str, str]


class _Node:
    """A part of one record's own schema."""

    __slots__ = ("steps", "kind", "rep", "kids", "column")

    def __init__(self, steps: tuple[Step, ...], kind: str, rep: int):
        self.steps, self.kind, self.rep = steps, kind, rep
        self.kids: dict[Step, _Node] = {}
        self.column: tuple[list[int], list[int], list] = ([], [], [])

    def kid(self, name: str, kind: str) -> _Node:
        k = (name, kind)
        if k not in self.kids:
            self.kids[k] = _Node((*self.steps, k), kind, self.rep + (kind == ARRAY))
        return self.kids[k]


def _kind(value) -> str:
    return ARRAY if isinstance(value, list) else LONE if isinstance(value, dict) else LEAF


def _grow(root: _Node, value, leaves: bool) -> None:
    """Add to root's schema what value holds; texts that hold JSON are replaced in place."""
    todo = [(root, value)]
    while todo:
        node, value = todo.pop()
        if isinstance(value, dict):
            for name, x in value.items():
                value[name] = x = unwrap(x)
                kind = _kind(x)
                if kind != LEAF:
                    todo.append((node.kid(name, kind), x))
                elif leaves:
                    node.kid(name, LEAF)
        else:
            for i, x in enumerate(value):
                value[i] = x = unwrap(x)
                if isinstance(x, dict):
                    todo.append((node, x))
                elif isinstance(x, list):
                    todo.append((node.kid("", ARRAY), x))


def _stripe(root: _Node, value) -> None:
    """Fill the columns below root, for one record. Members wait on a stack in the order of the record."""
    todo: list[tuple[_Node, object, int, int]] = [(root, value, 0, 0)]
    while todo:
        owner, x, r, d = todo.pop()
        nested = owner.kind == ARRAY and isinstance(x, list)  # an array's element that is an array
        members = x if isinstance(x, dict) else None
        for (name, kind), node in owner.kids.items():
            if nested:
                value = x if name == "" and kind == ARRAY else _GONE
            elif members is not None and name in members and _kind(members[name]) == kind:
                value = members[name]
            else:
                value = _GONE
            rep, deep, values = node.column
            if kind == LEAF:
                rep.append(r)
                deep.append(d + (value is not _GONE and value is not None))
                values.append(value)
            elif kind == LONE:
                there = value is not _GONE
                rep.append(r)
                deep.append(d + there)
                values.append(None)
                if node.kids:
                    todo.append((node, value if there else None, r, d + there))
            elif value is _GONE or not value:
                rep.append(r)
                deep.append(d + (value is not _GONE))
                values.append(_GONE)
                if node.kids:
                    todo.append((node, None, r, d + (value is not _GONE)))
            else:
                inside = []
                for i, element in enumerate(value):
                    at, level = r if i == 0 else node.rep, d + 2 + (element is not None)
                    rep.append(at)
                    deep.append(level)
                    values.append(element)
                    inside.append((node, element, at, level))
                if node.kids:
                    todo.extend(reversed(inside))


def shred(text: str | None, leaves: bool = True) -> list[tuple[tuple[Step, ...], list[int], list[int], list]] | None:
    """Level columns of one record: (steps, repetition levels, definition levels, values).

    None if text is null or no complete JSON. Texts that hold JSON array or object text count as
    what they hold, the record's own text too. With leaves=False only the columns of arrays and lone
    objects are made, all that positions need. A record that is a scalar gives no columns. A column
    of an array holds as value the scalars among its elements; objects and arrays stand in columns
    of their own.
    """
    if text is None:
        return None
    try:
        value = parse_exact(text)
        if isinstance(value, str):
            value = unwrap(value)
        root = _Node((), LONE, 0)
        if isinstance(value, dict):
            _grow(root, value, leaves)
            _stripe(root, value)
        elif isinstance(value, list):
            _grow(root.kid("", ARRAY), value, leaves)
            _stripe(root, {"": value})
    except ValueError:
        return None
    out, todo = [], list(root.kids.values())
    while todo:
        n = todo.pop()
        out.append((n.steps, *n.column))
        todo.extend(n.kids.values())
    return out


def _levels(steps: tuple[Step, ...]) -> list[int]:
    """Definition level at which each step is wholly there."""
    out, d = [], 0
    for _, kind in steps:
        d += 3 if kind == ARRAY else 1
        out.append(d)
    return out


def positions(steps: tuple[Step, ...], rep: list[int], deep: list[int], less: int = 0) -> Iterator[tuple[int, list[int]]]:
    """From a column's level sequences alone: (entry, index at each array step) of each entry that has an element at its last array.

    With less=1, also of entries whose last array is there without elements.
    """
    arrays = [i for i, (_, kind) in enumerate(steps) if kind == ARRAY]
    have = _levels(steps)
    need = have[arrays[-1]] - 1 - less if arrays else 0
    at = [-1] * len(arrays)
    for i, (r, d) in enumerate(zip(rep, deep, strict=True)):
        if r == 0:
            at = [0] * len(arrays)
        else:
            at[r - 1] += 1
            at[r:] = [0] * (len(arrays) - r)
        if d >= need:
            yield i, at[:]


def template(steps: tuple[Step, ...]) -> str:
    """Names joined by dots, a place for each array's position in brackets, lone objects marked; to be filled with % ."""
    out = []
    for name, kind in steps:
        if name or kind != ARRAY:
            out.append(("." if out else "") + name.replace("%", "%%"))
        if kind == ARRAY:
            out.append("[%d]")
        elif kind == LONE:
            out.append(MARK)
    return "".join(out)


def chains(steps: tuple[Step, ...]) -> list[str]:
    """For each step a digest of the fields down to it, without positions and kinds; of one length, however deep the field is."""
    out, last = [], b""
    for name, kind in steps:
        if name or kind != ARRAY:
            last = hashlib.blake2b(last + b"\0" + name.encode("utf-8", "surrogatepass"), digest_size=12).digest()
        out.append(last.hex())
    return out


def _marks(steps: tuple[Step, ...], digests: list[str]) -> list[str]:
    return [digest for digest, (_, kind) in zip(digests, steps, strict=True) if kind == LONE]


def objects(columns) -> Iterator[tuple[str, str, bool, list[str]]]:
    """(path with marks, chain, is an array's element, chain of each marked step) of each object but the root."""
    for steps, rep, deep, values in columns:
        kind = steps[-1][1]
        if kind == LEAF:
            continue
        full, shape = _levels(steps)[-1], ""
        for i, at in positions(steps, rep, deep):
            if deep[i] >= full and (kind == LONE or isinstance(values[i], dict)):
                if not shape:
                    shape, digests = template(steps), chains(steps)
                    marks = _marks(steps, digests)
                yield shape % tuple(at), digests[-1], kind == ARRAY, marks


_OBJECTS = "id long, blob string, path string, chain string, element boolean, marks array<string>"


def _find_objects(blobs: list[str]):
    schema = pa.schema([("id", pa.int64()), ("blob", pa.string()), ("path", pa.string()), ("chain", pa.string()), ("element", pa.bool_()), ("marks", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):  # few texts at once are Python objects
                out = []
                ids = batch.column(0).slice(start, 1000).to_pylist()
                for k, blob in enumerate(blobs, 1):
                    for i, text in zip(ids, batch.column(k).slice(start, 1000).to_pylist(), strict=True):
                        for row in objects(shred(text, leaves=False) or ()):
                            out.append((i, blob, *row))
                cols = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return run


def _resolved(rows: DataFrame, paths: list[str]) -> DataFrame:
    """Settle the marks in the columns named: [0] where the field is repeated in any row, nothing elsewhere.

    rows: blob, chain, element, marks and the paths. Adds `last`: whether the last mark is repeated (null
    without marks). The distinct lists of marks, as few as the records have shapes, are looked up in the
    distinct repeated fields; the rows only take the answer, so no row is moved for a hot field's sake.
    """
    repeated = rows.filter("element").select("blob", F.col("chain").alias("mark"), F.lit(True).alias("is_repeated")).distinct()
    shapes = rows.filter(F.size("marks") > 0).select("blob", "marks").distinct()
    answers = (
        shapes.select("blob", "marks", F.posexplode("marks").alias("nth", "mark"))
        .join(repeated, ["blob", "mark"], "left")
        .groupBy("blob", "marks")
        .agg(F.array_sort(F.collect_list(F.struct("nth", F.coalesce("is_repeated", F.lit(False)).alias("yes")))).alias("yes"))
    )

    def text(path: str):
        bits = F.split(path, MARK, -1)
        return F.concat(
            F.array_join(F.transform("yes", lambda y: F.concat(F.coalesce(F.get(bits, y["nth"]), F.lit("")), F.when(y["yes"] & (F.size(bits) > y["nth"] + 1), "[0]").otherwise(""))), ""),
            F.when(F.size(bits) > F.size("yes"), F.element_at(bits, -1)).otherwise(""),
        )

    return small_join(rows, answers, ["blob", "marks"], "left").select(
        *[c for c in rows.columns if c not in paths],
        *[F.when(F.col("yes").isNull(), F.col(p)).otherwise(text(p)).alias(p) for p in paths],
        F.element_at("yes", -1)["yes"].alias("last"),
    )


def found_objects(df: DataFrame, id_col: str, blobs: list[str]) -> DataFrame:
    """(id, blob, path): one row for each JSON object that is an array's element, in any of the blob columns.

    Nulls, incomplete JSON and scalars give no rows; extra columns of df are not read; an empty df gives
    no rows. Repeated ids give repeated rows. A lone object in a field that holds arrays of objects in
    other rows counts as [0].
    """
    raw = spread(df.select(F.col(id_col).cast("long").alias("id"), *[F.col(b).cast("string") for b in blobs])).mapInArrow(_find_objects(blobs), _OBJECTS)
    return _resolved(materialise(raw), ["path"]).filter(F.col("element") | F.col("last")).select("id", "blob", "path")


def assemble(columns) -> Iterator[tuple[str, str, str, str, bool, list[str], list[tuple[str, str]]]]:
    """Flat rows from level columns: (path, parent, level, chain, is an element, marks, fields) of each object and element.

    Fields are (name, JSON text); null has the text null, an absent field has none; an empty array stands
    as [] in its parent. A scalar element, or null, is a field without a name in its own row.
    """
    rows: dict[tuple[str, str], list] = {}
    shapes: dict[tuple[Step, ...], tuple] = {}

    def row(steps: tuple[Step, ...], at: list[int]) -> list:
        shape = shapes.get(steps)
        if shape is None:
            level = ".".join(n + (ARRAY if k == ARRAY else "") for n, k in steps).replace(".[]", "[]")
            digests = chains(steps)
            up = None if not steps else (template(steps[:-1]), sum(k == ARRAY for _, k in steps[:-1]))
            shape = shapes[steps] = (template(steps), "".join(k or "-" for _, k in steps), up, level, digests[-1] if digests else "", bool(steps) and steps[-1][1] == ARRAY, _marks(steps, digests))
        path, kinds, up, level, own, element, marks = shape
        key = (path % tuple(at), kinds)
        found = rows.get(key)
        if found is None:
            found = rows[key] = [key[0], up and up[0] % tuple(at[: up[1]]), level, own, element, marks, []]
        return found

    row((), [])
    for steps, rep, deep, values in columns:
        *up, (name, kind) = steps
        up = tuple(up)
        full = _levels(steps)[-1]
        if kind == ARRAY:
            for i, at in positions(steps, rep, deep):
                one = row(steps, at)
                if not isinstance(values[i], (dict, list)):
                    one[-1].append(("", json.dumps(values[i]) if not isinstance(values[i], Number) else values[i].text))
            for i, at in positions(steps, rep, deep, less=1):
                if deep[i] == full - 2:  # an array without elements
                    row(up, at[:-1])[-1].append((name, "[]"))
        else:
            for i, at in positions(up, rep, deep):
                if kind == LONE and deep[i] == full:
                    row(steps, at)
                elif kind == LEAF and values[i] is not _GONE:
                    row(up, at)[-1].append((name, values[i].text if isinstance(values[i], Number) else json.dumps(values[i])))
    yield from map(tuple, rows.values())


_ROWS = pa.schema(
    [("id", pa.int64()), ("blob", pa.string()), ("path", pa.string()), ("parent_path", pa.string()), ("level", pa.string()), ("chain", pa.string())]
    + [("element", pa.bool_()), ("marks", pa.list_(pa.string())), ("fields", pa.map_(pa.string(), pa.string()))]
)


def _find_rows(blobs: list[str]):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start in range(0, len(ids), 500):  # a record has many rows; keep what is sent at once small
                out = []
                for k, blob in enumerate(blobs, 1):
                    texts = batch.column(k).slice(start, 500).to_pylist()
                    for i, text in zip(ids[start : start + 500], texts, strict=True):
                        columns = shred(text)
                        out += [(i, blob, *r) for r in assemble(columns)] if columns is not None else []
                cols = list(zip(*out, strict=True)) if out else [[]] * len(_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ROWS.types, strict=True)], schema=_ROWS)

    return run


def flat_tables(df: DataFrame, id_col: str, blobs: list[str]) -> DataFrame:
    """All levels in one long table: (id, blob, level, path, parent_path, fields), nothing lost.

    One row for each record (level and path are empty), object and array element; parent_path links it to
    its parent's row, id to the row of df. fields maps names to JSON text. select_level() makes typed tables.
    Incomplete JSON and nulls have no rows. A name repeated within an object keeps its last value.
    """
    raw = spread(df.select(F.col(id_col).cast("long").alias("id"), *[F.col(b).cast("string") for b in blobs])).mapInArrow(
        _find_rows(blobs),
        "id long, blob string, path string, parent_path string, level string, chain string, element boolean, marks array<string>, fields map<string,string>",
    )
    done = _resolved(materialise(raw), ["path", "parent_path"])
    level = F.regexp_replace("path", r"\[\d+\]", "[]")
    return done.select("id", "blob", level.alias("level"), "path", "parent_path", "fields")


def select_level(tables: DataFrame, blob: str, level: str, columns: dict[str, str]) -> DataFrame:
    """One flat table of a level: id, path, parent_path and the named fields, cast to the given types (null where a cast fails)."""
    one = tables.filter((F.col("blob") == blob) & (F.col("level") == level))
    value = lambda n: F.element_at("fields", n)
    plain = lambda n: F.when(value(n).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value(n), F.lit("}")), "$.v")).otherwise(F.nullif(value(n), F.lit("null")))
    return one.select("id", "path", "parent_path", *[plain(n).try_cast(t).alias(n or "value") for n, t in columns.items()])
