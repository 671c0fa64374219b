import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodepath.functions.jsontext import canonical, parse_exact
from lodepath.operators import shredding as S

_SCALAR = st.none() | st.booleans() | st.integers(-9, 9) | st.text(st.characters(codec="utf-8", exclude_characters="\x1e"), max_size=3).filter(lambda s: s.lstrip(" \t\r\n")[:1] not in ("[", "{"))
_JSON = st.recursive(_SCALAR, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("abc"), x, max_size=3), max_leaves=12)


def rebuild(rows):
    """A record from its flat rows, by their paths alone."""
    by = {path: dict(fields) for path, _, _, _, _, _, fields in rows}
    root = {k: json.loads(v) for k, v in by.pop("").items()}
    import re

    for path in sorted(by, key=lambda p: len(re.findall(r"\[|\x1e", p))):
        steps = re.findall(r"\[(\d+)\]|([^.\[\]\x1e]+)|(\x1e)", path)
        at, key = root, None
        for i, (pos, name, mark) in enumerate(steps):
            if mark:
                continue
            key = int(pos) if pos else name
            following = next((s for s in steps[i + 1 :] if not s[2]), None)
            if following is None:
                break
            at = at.setdefault(key, [] if following[0] else {}) if isinstance(at, dict) else _slot(at, key, [] if following[0] else {})
        value = json.loads(by[path][""]) if set(by[path]) == {""} else {k: json.loads(v) for k, v in by[path].items()}
        if isinstance(at, dict):
            at[key] = value
        else:
            _slot(at, key, value, True)
    return root


def _slot(a, i, value, put=False):
    while len(a) <= i:
        a.append(None)
    if put or a[i] is None:
        a[i] = value
    return a[i]


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.sampled_from("abc"), _JSON, max_size=3))
def test_nothing_is_lost(record):
    def count(v):
        if isinstance(v, dict):
            return sum(map(count, v.values()))
        if isinstance(v, list):
            return 1 if not v else sum(map(count, v))
        return 1

    rows = list(S.assemble(S.shred(json.dumps(record))))
    nested_empty = json.dumps(record).count("[[]") + json.dumps(record).count(", []")
    got = sum(len(r[-1]) for r in rows)
    assert got <= count(record) and got + nested_empty >= count(record)
    paths = [r[0] for r in rows]
    assert all(r[1] is None or r[1] in paths or r[1].endswith("]") for r in rows)


def test_round_trip():
    record = {"a": [{"b": [{"c": 1}, None, {"c": None, "d": []}], "e": "x"}, {"b": None}, {}], "n": 1.5, "t": ["p", None, 2], "o": {"q": True}}
    assert rebuild(list(S.assemble(S.shred(json.dumps(record))))) == {**record, "a": [record["a"][0], {"b": None}, {}]}


def test_levels_of_a_known_record():
    """Levels as in the literature: a repeated group within a repeated group."""
    columns = {tuple(s): (r, d) for s, r, d, _ in S.shred('{"a":[{"b":[{"c":1},{"c":2}]},{"b":[]},null,{"b":[{"c":null}]}]}')}
    assert columns[(("a", "[]"), ("b", "[]"), ("c", ""))] == ([0, 2, 1, 1, 1], [7, 7, 4, 2, 6])


def brute(rows, blobs):
    """Objects in arrays by plain recursion, lone objects resolved over all rows."""

    def un(v):
        while isinstance(v, str) and v.lstrip()[:1] in ("[", "{"):
            try:
                v = json.loads(v)
            except ValueError:
                return v
        return v

    parsed, repeated = [], set()
    for i, *texts in rows:
        for b, t in zip(blobs, texts, strict=True):
            try:
                parsed.append((i, b, un(json.loads(t))))
            except (ValueError, TypeError):
                continue

    def note(b, v, chain):
        v = un(v)
        if isinstance(v, dict):
            for k, x in v.items():
                if isinstance(un(x), list) and any(isinstance(un(e), dict) for e in un(x)):
                    repeated.add((b, (*chain, k)))
                note(b, x, (*chain, k))
        elif isinstance(v, list):
            for x in v:
                note(b, x, chain)

    out = set()

    def walk(i, b, v, chain, path):
        v = un(v)
        if isinstance(v, dict):
            for k, x in v.items():
                p = f"{path}.{k}" if path else k
                if isinstance(un(x), dict) and (b, (*chain, k)) in repeated:
                    p += "[0]"
                    out.add((i, b, p))
                walk(i, b, x, (*chain, k), p)
        elif isinstance(v, list):
            for n, x in enumerate(v):
                if isinstance(un(x), dict):
                    out.add((i, b, f"{path}[{n}]"))
                walk(i, b, x, chain, f"{path}[{n}]")

    for _, b, v in parsed:
        note(b, v, ())
    for i, b, v in parsed:
        walk(i, b, v, (), "")
    return out


ROWS = [
    (1, '{"a":[{"b":{"c":1}},null,{"b":[{"c":2}]}],"x":{"y":{"z":[{}]}}}', None),
    (2, '{"a":{"b":"[{\\"c\\": 3}]"}}', '[{"k":1},[{"k":2}]]'),
    (3, json.dumps('{"a":"[{\\"b\\":null}]"}'), "{"),
    (4, "[]", "3"),
    (5, "", '{"a": NaN}'),
    (1, '{"a":[{}]}', '{"q":"[not json"}'),
]


def test_found_objects(spark):
    df = spark.createDataFrame([(*r, "clash", "p") for r in ROWS], "row_id long, u string, v string, id string, path string")
    got = {tuple(r) for r in S.found_objects(df, "row_id", ["u", "v"]).collect()}
    assert got == brute(ROWS, ["u", "v"])
    assert S.found_objects(df.limit(0), "row_id", ["u", "v"]).count() == 0


def test_tables(spark):
    df = spark.createDataFrame(ROWS, "row_id long, u string, v string")
    tables = S.flat_tables(df, "row_id", ["u", "v"])
    one = S.select_level(tables, "u", "a[].b[]", {"c": "int"}).collect()
    assert {(r.id, r.path, r.parent_path, r.c) for r in one} == {(1, "a[0].b[0]", "a[0]", 1), (1, "a[2].b[0]", "a[2]", 2), (2, "a[0].b[0]", "a[0]", 3)}


def test_canonical():
    same = ['{"a":1,"b":"\\u0041"}', ' {"b" : "A", "a":1}']
    assert len({canonical(parse_exact(x)) for x in same}) == 1
    assert len({canonical(parse_exact(x)) for x in ('{"a":1}', '{"a":1.0}', '{"a":"1"}')}) == 3


@pytest.mark.parametrize("deep", [400, 2500])
def test_deep_records_are_shredded_whole(deep):
    """Lone objects, arrays in arrays, and arrays of objects, each nested beyond Python's own limit."""
    lone = S.shred('{"a":' * deep + "1" + "}" * deep)
    assert len(lone) == deep and sum(steps[-1][1] == S.LEAF for steps, *_ in lone) == 1
    lists = S.shred("[" * deep + "1" + "]" * deep)
    assert max(len(S.positions(steps, rep, found) and list(S.positions(steps, rep, found))[0][1]) for steps, rep, found, _ in lists) == deep
    mixed = S.shred('{"a":[null,' * deep + "{}" + "]}" * deep)
    paths = [path for path, *_ in S.objects(mixed)]
    assert len(paths) == deep and max(paths, key=len) == ".".join(["a[1]"] * deep)


def test_deep_rows(spark):
    text = '{"a":[' * 300 + '{"v":7}' + "]}" * 300
    df = spark.createDataFrame([(1, text)], "row_id long, b string")
    assert S.found_objects(df, "row_id", ["b"]).count() == 300
    rows = S.flat_tables(df, "row_id", ["b"]).collect()
    last = max(rows, key=lambda r: len(r.path))
    assert len(rows) == 301 and last.fields == {"v": "7"} and last.parent_path == last.path[: -len(".a[0]")]
