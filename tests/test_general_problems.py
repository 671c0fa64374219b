"""Drift, compaction and profiles against plain versions on small fixtures."""

import gzip
import json
import os
import zlib

import pytest
from pages import gz
from pyspark.sql import functions as F

from lodepath.errors import IngestError
from lodepath.functions.jsontext import record_digest
from lodepath.operators import compaction as C
from lodepath.operators import drift as D
from lodepath.operators import profiling as P
from lodepath.operators.upsert import last_wins, upsert
from lodepath.plans import problems
from lodepath.session import fits, small_join

# --- drift ---
RECORDS = [
    (1, 1, {"id": "a", "t": 1, "u": [], "g": {"x": 1, "y": 2}, "job_information": {"v": ["p"]}}),
    (1, 1, {"id": "b", "t": 2, "u": None, "g": None, "job_information": {"v": None}}),
    (1, 3, {"id": "a", "tok": 1, "u": ["s"], "h": {"y": 2, "x": 1}, "job_information": {"w": ["p"]}}),
    (1, 3, {"id": "b", "tok": 2, "u": [], "job_information": {}}),
    (1, 3, {"id": "c", "tok": 9, "h": 5, "job_information": {"w": [None, [1]]}}),
    (1, 4, {"id": "z", "k": None, "job_information": {}}),
    (2, 1, {"id": "a", "only": True}),
]


def drift_frame(spark, records=RECORDS, extra=()):
    rows = [(i, f, d, json.dumps(r) if not isinstance(r, str) else r, "x") for i, (f, d, r) in enumerate([*records, *extra])]
    return spark.createDataFrame(rows, "record_id long, feed_id long, drop_no long, record_json string, path string")


def load(df, **k):
    return D.load_fields(df, "record_id", "feed_id", "drop_no", "record_json", ["job_information", "v5_processed_job_data"], **k)


def test_changes(spark):
    got = {tuple(r) for r in D.changes(load(drift_frame(spark, extra=[(1, 3, "{broken"), (1, 3, None)]))).collect()}
    assert got == {
        (1, 3, "renamed", "t", "tok"), (1, 3, "renamed", "g", "h"), (1, 3, "renamed", "job_information.v", "job_information.w"), (1, 3, "type_changed", "u", ""),
        (1, 4, "removed", "tok", ""), (1, 4, "removed", "u", ""), (1, 4, "removed", "h", ""), (1, 4, "removed", "job_information.w", ""), (1, 4, "added", "k", ""),
    }
    assert D.changes(load(drift_frame(spark, []))).count() == 0


def test_integers_and_floats_are_different_values(spark):
    rows = [(1, 1, {"id": "a", "p": 5, "q": 1.50}), (1, 2, {"id": "a", "n": 5.0, "r": 15e-1})]
    got = {tuple(r) for r in D.changes(load(drift_frame(spark, [*rows[:1], (1, 2, '{"id":"a","n":5.0,"r":15e-1}')]))).collect()}
    assert got == {(1, 2, "removed", "p", ""), (1, 2, "added", "n", ""), (1, 2, "renamed", "q", "r")}


def test_drop_of_objects_without_fields(spark):
    got = {tuple(r) for r in D.changes(load(drift_frame(spark, [(1, 1, {"x": 1}), (1, 2, {}), (1, 3, {"x": 1})]))).collect()}
    assert got == {(1, 2, "removed", "x", ""), (1, 3, "added", "x", "")}
    rows = D.consistent(load(drift_frame(spark, [(1, 2, {}), (1, 3, "{")]), values=True), spark.createDataFrame([], "path string, name string"), {"x": "int"}).collect()
    assert sorted((r.row, r.unreadable) for r in rows) == [(0, False), (1, True)]


@pytest.mark.parametrize("deep", [900, 20_000])
def test_deep_values(spark, deep):
    """Depth beyond Python's own limit changes nothing."""
    text = '{"id":"a","%s":' + '{"y":[' * deep + "%s" + "]}" * deep + "}"
    got = {tuple(r) for r in D.changes(load(drift_frame(spark, [(1, 1, text % ("v", 1)), (1, 2, text % ("w", 1)), (1, 3, text % ("x", 2))]))).collect()}
    assert got == {(1, 2, "renamed", "v", "w"), (1, 3, "removed", "w", ""), (1, 3, "added", "x", "")}
    assert record_digest(text % ("v", 1)) == record_digest((text % ("v", " 1 ")).encode()) != record_digest(text % ("v", 2))
    assert record_digest((text % ("v", 1))[:-1]) is None


def test_consistent(spark):
    fields = load(drift_frame(spark, extra=[(1, 4, "oops")]), values=True).cache()
    names = D.unified_names(D.changes(fields))
    known = {r.path: r.name for r in names.collect()}
    assert known["tok"] == known["t"] == "t"
    rows = {r.row: r for r in D.consistent(fields, names, {"t": "int", "u": "int", "only": "boolean"}).collect()}
    assert len(rows) == 8 and rows[0].t == 1 and rows[4].t == 9
    assert rows[2].t == 1
    assert rows[2].u is None and any(f.path == "u" for f in rows[2].failed_casts) and rows[6].only is True and rows[7].unreadable


# --- compaction ---
def files(spark, extra=()):
    a, b = {"x": 1, "y": "é"}, {"x": 1.0, "y": "é"}
    body = [gz(a), gz(json.dumps({"y": "é", "x": 1}, indent=1, ensure_ascii=False).encode()), gz(b), gz(b"[1]"), gz(a)[:-14], gz(a)[:-6], b"{}", b"", None, gz(b'{"x":1} x'), gz(a) + b"garbage"]
    rows = [(i, "r", f"f{i}", len(c or b""), None if c is None else bytearray(c), "k") for i, c in enumerate(body)]
    return spark.createDataFrame([*rows, *extra], "file_id long, root_dir string, file_name string, size_bytes long, content binary, digest string")


def test_redundant(spark):
    got = {r[0] for r in C.redundant(C.digests(files(spark))).collect()}
    assert got == {1, 3, 4, 5, 6, 7, 8, 9, 10}
    assert C.redundant(C.digests(files(spark).limit(0))).count() == 0


def test_first_fit_decreasing():
    sizes = [5, 7, 5, 2, 4, 2, 5, 1, 6, 0, 20]
    bins = C.first_fit_decreasing(sizes, 10)
    load = {}
    for s, b in zip(sizes, bins, strict=True):
        load[b] = load.get(b, 0) + s
    assert sorted(load.values()) == [7, 10, 10, 10, 20] and C.first_fit_decreasing([], 5) == []
    assert max(C.first_fit_decreasing([0, 0, 0], 5)) == 0


def test_compact(spark, tmp_path):
    out = str(tmp_path / "out")
    record = C.compact(files(spark), out, 200)
    assert record["rows"] == 2 and json.load(open(os.path.join(out, "CURRENT")))["version"] == record["version"]
    back = spark.read.parquet(os.path.join(out, record["version"])).collect()
    assert sorted(json.loads(gzip.decompress(bytes(r.content)))["x"] for r in back) == [1, 1.0]
    assert not [n for n in os.listdir(out) if n.startswith("_staging")]


def test_compact_of_a_plan_beyond_broadcast(spark, tmp_path, monkeypatch):
    contents = [gz({"v": i % 40}) for i in range(90)] + [b"", None]
    rows = [(i, f"f{i}", len(c or b""), c) for i, c in enumerate(contents)]
    df = spark.createDataFrame([*rows, rows[3]], "file_id long, file_name string, size_bytes long, content binary")
    monkeypatch.setattr(C, "fits", lambda *_: False)
    monkeypatch.setattr(C, "SHARD_FILES", 15)
    record = C.compact(df, str(tmp_path / "out"), 200)
    back = spark.read.parquet(str(tmp_path / "out" / record["version"])).collect()
    assert sorted(r.file_id for r in back) == list(range(40)) and record["left_out"] == 53
    load = {}
    for r in back:
        load[r.bin] = load.get(r.bin, 0) + len(r.content)
    assert max(load.values()) <= 200 and record["bins"] == len(load)


def test_gunzip_keeps_all_before_an_error():
    raw = json.dumps({"x": list(range(60_000))}).encode()
    whole = gz(raw)
    assert C.gunzip(whole) == raw and C.gunzip(whole + whole) == raw + raw
    for cut in (len(whole) // 3, len(whole) - 9, len(whole) - 3):
        bent = bytearray(whole)
        bent[cut] ^= 0xFF
        z, want = zlib.decompressobj(31), b""
        try:
            for i in range(len(bent)):
                want += z.decompress(bytes(bent[i : i + 1]))
        except zlib.error:
            pass
        assert C.gunzip(bytes(bent)).startswith(want)


def test_failed_verification_commits_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "_checksum", lambda df, n=[0]: (n.append(1) or len(n), "x"))
    with pytest.raises(IngestError):
        C.compact(files(spark), str(tmp_path / "out"), 200)
    assert not os.path.exists(tmp_path / "out" / "CURRENT")


def test_p5_compact_writes_all_that_is_kept(spark, tmp_path):
    import __spark_entry__ as entry

    contents = [gz({"v": i % 5}) for i in range(12)] + [b"", None]
    rows = [(i, f"f{i}", len(c or b""), c) for i, c in enumerate(contents)]
    spark.createDataFrame(rows, "file_id long, file_name string, size_bytes long, content binary").write.parquet(f"{tmp_path}/raw_files.parquet")
    got = entry.queries()["p5_compact"](spark, str(tmp_path)).collect()
    kept = C.digests(spark.createDataFrame(rows[:5], "file_id long, file_name string, size_bytes long, content binary"))
    assert sum(r.rows for r in got) == 5 and sum(r.bytes for r in got) == sum(r[2] for r in rows[:5])
    assert sum(int(r.checksum) for r in got) == int(C._checksum(kept)[1])


# --- profiles ---
JOBS = [
    (1, 1, 50000.0, 60000.0, "Lead", '["US"]'), (1, 2, 70000.0, 60000.0, "lead", '["US","US"]'), (1, 3, float("nan"), None, None, "[]"), (1, 4, 999.0, None, "Director", '["XX"]'), (1, 5, None, None, "Lead", "['US']"),
    (2, 6, 70000.0, None, "Director", None), (2, 7, 70000.0, None, "Director", '["\\u0055S"]'), (2, 8, 70001.0, float("nan"), "Director", '["US",]'), (2, 9, 2e6, None, "Lead", '"US"'),
    (4, 10, None, None, None, None),
]
RUNS = [("r", 1), ("r", 2), ("r", 3), ("q", 4)]


def checked(spark, jobs=JOBS):
    df = spark.createDataFrame([(*j, "x") for j in jobs], "load_id long, row_id long, yearly_min_compensation double, yearly_max_compensation double, seniority_level string, workplace_countries string, pay string")
    codes = spark.createDataFrame([("US",), ("DE",), ("US",), (None,)], "country_code string")
    return P.with_validity(df, codes, "row_id", "load_id")


def test_offending(spark, monkeypatch):
    pay, level, place = "yearly_min_compensation", "seniority_level", "workplace_countries"
    want = {(1, 2, pay), (1, 3, pay), (1, 4, pay), (1, 2, level), (1, 2, place), (1, 4, place), (1, 5, place), (2, 8, place), (2, 9, place)}
    assert {tuple(r) for r in P.offending(checked(spark), "row_id", "load_id").collect()} == want
    monkeypatch.setattr(P, "fits", lambda *_: False)  # the way for many codes
    assert {tuple(r) for r in P.offending(checked(spark), "row_id", "load_id").collect()} == want


def test_changed_loads(spark):
    runs = spark.createDataFrame(RUNS, "root_dir string, load_id long")
    got = {tuple(r) for r in P.changed_loads(checked(spark), runs, "root_dir", "load_id").collect()}
    # pay: nulls .2 -> 0, median 50000 -> 70000.5; levels: nulls .2 -> 0; places: nulls 0 -> .25
    assert got == {(2, "yearly_min_compensation"), (2, "seniority_level"), (2, "workplace_countries")}
    assert P.changed_loads(checked(spark, []), runs, "root_dir", "load_id").count() == 0


def test_profile_and_shifts(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 10.0), (1, "b", None), (1, None, float("nan")), (2, "x" * 500, 1.0)], "load_id long, s string, n double")
    p = {(r.load_id, r.column_name): r for r in P.profile(df, ["load_id"], ["s", "n"], ["n"]).collect()}
    s, n = p[1, "s"], p[1, "n"]
    assert (s.rows, s.nulls, s.distincts, s.top_value, s.top_count, s.null_rate) == (4, 1, 2, "b", 2, 0.25)
    assert (n.min_number, n.max_number, n.distincts) == (2.0, 10.0, 3) and p[2, "s"].top_value.startswith("#500:")
    runs = spark.createDataFrame([("r", 1), ("r", 2)], "root_dir string, load_id long")
    shift = P.shifts(df, runs, "root_dir", "load_id", ["s"]).first()
    assert shift.half_abs == pytest.approx(1.0) and shift.chi_square > 4 and shift.psi > 1


def test_p6_profile_covers_every_column(spark, tmp_path):
    long = ["b" * 300, "a" * 300, None]
    rows = [(1, i, f"id{i}", long[i], 10.0 * i) for i in range(3)]
    spark.createDataFrame(rows, "load_id long, row_id long, id string, description string, pay double").write.parquet(f"{tmp_path}/jobs.parquet")
    got = {r.column_name: r for r in problems.p6_profile(spark, str(tmp_path)).collect()}
    assert set(got) == {"row_id", "id", "description", "pay"}
    d = got["description"]
    assert (d.rows, d.nulls, d.distincts, d.min_value, d.max_value) == (3, 1, 2, "a" * 300, "b" * 300)
    assert (got["id"].distincts, got["pay"].max_number, got["row_id"].max_number) == (3, 20.0, 2.0)


def test_p6_shifts_sees_a_changed_spread(spark, tmp_path):
    old = [float(x) for x in range(1, 101)]
    new = [50.5 + (x - 50.5) * 3 for x in old]  # the same median
    rows = [(1, x, "a", None) for x in old] + [(1, float("nan"), "a", 1)] + [(2, x, "a", 1) for x in new] + [(2, None, "a", 1), (3, None, "b", 1)]
    spark.createDataFrame(rows, "load_id long, pay double, level string, n long").write.parquet(f"{tmp_path}/jobs.parquet")
    spark.createDataFrame([("r", 1), ("r", 2), ("r", 3)], "root_dir string, load_id long").write.parquet(f"{tmp_path}/ingest_runs.parquet")
    got = {(r.load_id, r.column_name): r for r in problems.p6_shifts(spark, str(tmp_path)).collect()}
    assert set(got) == {(i, c) for i in (2, 3) for c in ("pay", "level", "n")}
    # tenths of load 1 against load 2: the edges 10, 20 ... 90 leave 37, 3, 3, 4, 3, 3, 4, 3, 3, 37 of the new values
    inside = [sum(lo < x <= hi for x in new) for lo, hi in zip([-1e9, *range(10, 100, 10)], [*range(10, 100, 10), 1e9], strict=True)]
    want = (sum(abs(m / 101 - 10 / 101) for m in inside) + 2 / 101) / 2  # NaN went, a null came
    assert got[2, "pay"].half_abs == pytest.approx(want, abs=1e-6) and want > 0.5
    assert got[2, "level"].half_abs == 0 and got[3, "level"].half_abs == 1 and got[2, "n"].half_abs == pytest.approx(100 / 101, abs=1e-6)


@pytest.mark.parametrize("rows", [0, 10**6])
def test_ranks_by_window_and_by_ranges(spark, rows, monkeypatch):
    monkeypatch.setattr(P, "RANKED_ROWS", rows)
    import random

    r = random.Random(3)
    held = {(g, float(v)): r.randint(1, 9) for g in ("x", "y") for v in r.sample(range(300), 90 if g == "x" else 7)}
    df = spark.createDataFrame([(g, v, n) for (g, v), n in held.items()], "g string, v double, n long")
    got = {(x.g, x.v): (x._upto, x._all) for x in P.ranked(df, ["g"], "v", rows=rows).collect()}
    assert got == {(g, v): (sum(n for (h, w), n in held.items() if h == g and w <= v), sum(n for (h, _), n in held.items() if h == g)) for g, v in held}
    import numpy as np

    q = {x.g: (x.a, x.b) for x in P.quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5}).collect()}
    for g, found in q.items():
        assert found == pytest.approx(tuple(np.quantile(np.repeat([v for (h, v) in held if h == g], [n for (h, _), n in held.items() if h == g]), (0.25, 0.5))))


def test_weighted_median(spark):
    counts = spark.createDataFrame([(1, 5.0, 1), (1, 7.0, 2), (1, 9.0, 1), (2, 1.0, 1), (2, 4.0, 1)], "g long, v double, n long")
    assert {(r.g, r.median) for r in P.weighted_median(counts, ["g"], "v").collect()} == {(1, 7.0), (2, 2.5)}


# --- keyed tables and joins ---
def test_upsert(spark):
    base = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, "c")], "k long, o long, v string")
    delta = spark.createDataFrame([(2, 1, "x"), (2, 3, "y"), (4, 1, "z")], "k long, o long, v string")
    got = upsert(base, delta, ["k"], ["o"], spark.createDataFrame([(3,)], "k long"))
    assert {(r.k, r.v) for r in got.collect()} == {(1, "a"), (2, "y"), (4, "z")}
    assert last_wins(delta.limit(0), ["k"], ["o"]).count() == 0


@pytest.mark.parametrize("rows", [0, 100])
def test_small_join(spark, rows):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, v string")
    right = spark.createDataFrame([(1, 10), (3, 30)], "k long, w long")
    assert fits(right, 2) and not fits(right, 1)
    for how, want in (("inner", {"a", "b"}), ("left", {"a", "b", "c", "d"}), ("left_semi", {"a", "b"}), ("left_anti", {"c", "d"})):
        assert {r.v for r in small_join(left, right, ["k"], how, rows).collect()} == want


def test_small_join_broadcasts_what_was_counted_only(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    left = spark.createDataFrame([(1, "a"), (2, "c")], "k long, v string")
    right = spark.createDataFrame([(1, "x"), (3, None)], "k long, `w.w` string")
    assert fits(right, 2, 3) and not fits(right, 2, 2) and fits(right.limit(0), 0, 0)
    assert "BroadcastHashJoin" in plan(small_join(left, right, ["k"], rows=2))
    wide = spark.range(3).select(F.col("id").alias("k"), F.repeat(F.lit("w"), 12 << 20).alias("w"))
    for df in (small_join(left, right, ["k"], rows=1), small_join(left, wide, ["k"], "left", rows=3)):
        assert "Broadcast" not in plan(df)
    assert {(r.v, r.n) for r in small_join(left, wide, ["k"], "left").select("v", F.length("w").alias("n")).collect()} == {("a", 12 << 20), ("c", 12 << 20)}
