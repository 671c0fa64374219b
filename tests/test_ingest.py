import os
import time

import pytest
from pages import gz, job, page

from lodepath.errors import IngestError, StatsUnavailable
from lodepath.plans.ingest import report, run_ingest
from lodepath.sources import sinks
from lodepath.sources.snapshot import Snapshots


def put(folder, name, data):
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else gz(page(data)))
    t = time.time() + (hash(data) % 1000 if isinstance(data, bytes) else len(os.listdir(folder)))
    os.utime(path, (t, t))


def keys(spark, out):
    return {r.requisition_id: r.title for r in Snapshots(spark, out).read("jobs").collect()}


def test_life_of_a_corpus(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    put(src, "a.json.gz", job("k1"))
    put(src, "b.json.gz", job("k2"))
    put(src, "c%20 d.json.gz", job("k3"))
    put(src, "bad.json.gz", b"no gzip")
    (src / "empty.json.gz").write_bytes(b"")
    (src / "x.json.gz.part").write_bytes(b"half")
    r = run_ingest(spark, str(src), out)
    assert (r.files, r.parsed, r.ok, r.errors, r.full, r.total_rows) == (5, 5, 3, 2, True, 3)
    assert len(r.error_samples) == 2 and all(e.startswith("gunzip:") for e in r.error_samples) and "3 ok" in report(r)
    # nothing has changed: only the failed files are tried again
    r = run_ingest(spark, str(src), out)
    assert (r.skipped, r.parsed, r.errors, r.full, r.total_rows) == (3, 2, 2, False, 3)
    # a changed file, a changed key, a deleted file, a new one
    put(src, "a.json.gz", job("k1", job_information={"title": "New", "job_title_raw": "r", "description": "longer than before"}))
    put(src, "b.json.gz", job("k9"))
    os.unlink(src / "c%20 d.json.gz")
    put(src, "e.json.gz", job("k5"))
    r = run_ingest(spark, str(src), out)
    assert (r.ok, r.total_rows) == (3, 4)
    assert keys(spark, out) == {"k1": "New", "k9": "T", "k3": "T", "k5": "T"}
    # a changed file that is no longer valid keeps its row
    put(src, "e.json.gz", b"broken")
    assert "k5" in keys(spark, out) and run_ingest(spark, str(src), out).errors == 3 and "k5" in keys(spark, out)
    # a full run forgets
    r = run_ingest(spark, str(src), out, full=True)
    assert r.full and keys(spark, out) == {"k1": "New", "k9": "T"}
    # an unreadable pointer makes the next run full; limits
    (tmp_path / "out" / "CURRENT").write_text("{")
    r = run_ingest(spark, str(src), out, limit=1)
    assert r.full and r.files == 1
    with pytest.raises(ValueError, match="limit must be positive"):
        run_ingest(spark, str(src), out, limit=0)
    assert Snapshots(spark, out).expire(1)
    info = Snapshots(spark, out).info()
    assert info["rows"] == info["manifest_entries"] == 1 and info["bytes"] > 0 and Snapshots(spark, str(tmp_path / "no")).info()["rows"] is None


def test_equal_keys_last_name_wins(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for n in ("a", "c", "b"):
        put(src, f"{n}.json.gz", job("k", job_information={"title": n, "job_title_raw": "r", "description": "d"}))
    assert run_ingest(spark, str(src), out).total_rows == 1 and keys(spark, out) == {"k": "c"}


def test_missing(spark, tmp_path):
    with pytest.raises(IngestError):
        run_ingest(spark, str(tmp_path / "none"), str(tmp_path / "out"))
    with pytest.raises(StatsUnavailable):
        Snapshots(spark, str(tmp_path / "none")).read("jobs")


def test_stream(spark, tmp_path):
    from lodepath.streaming.incremental import ingest_stream

    src, out, got = tmp_path / "in", str(tmp_path / "out"), []
    src.mkdir()
    put(src, "a.json.gz", job("k1"))
    q = ingest_stream(spark, str(src), out, str(tmp_path / "cp"), got.append, once=True)
    q.awaitTermination(120)
    assert got and got[-1].total_rows == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("k1", 1.5, True), ("k2", None, False)], "requisition_id string, x double, b boolean")
    assert sinks.write_sqlite(df, str(tmp_path / "t.db")) == 2
    assert sinks.write_sqlite(df.limit(1).withColumn("x", df.x + 1), str(tmp_path / "t.db"), replace=False) == 2
    sinks.write_parquet(df, str(tmp_path / "p"), 1)
    assert any(".zstd.parquet" in f for f in os.listdir(tmp_path / "p"))
    n = sinks.write_ipc(df, str(tmp_path / "t.arrow"))
    with pytest.raises(IngestError):
        sinks.read_ipc(str(tmp_path / "t.arrow"), n + 1)
    sinks.write_jsonl(df, str(tmp_path / "j"))


def test_raw_page_round_trip(spark, tmp_path):
    j = job("K:1")
    del j["apply_url"]
    assert sinks.write_raw_page(j, str(tmp_path / "raw")) is None
    path = sinks.write_raw_page(j, str(tmp_path / "raw"), {"hc_apply_url": "u"})
    assert path.endswith(".json.gz") and os.listdir(tmp_path / "raw") == [os.path.basename(path)]
    assert run_ingest(spark, str(tmp_path / "raw"), str(tmp_path / "out")).ok == 1
