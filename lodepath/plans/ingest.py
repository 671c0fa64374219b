"""Incremental ingest: directory of gzipped pages -> keyed table, in one commit."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IngestError
from ..operators.stats import megabytes
from ..schema import JOBS, KEY
from ..session import cancellable, materialise, small_join
from ..sources.files import compared, list_inputs, parse_paths
from ..sources.snapshot import BUCKET, Snapshots, bucket

_MANIFEST = "root_dir string, file_name string, mtime_us bigint, size_bytes bigint, requisition_id string"
_FILE = ["root_dir", "file_name"]
#: Error texts kept in a result.
SAMPLES = 10
#: Rows that a bucket is made for when a table is built anew; their number stays until the next full run.
BUCKET_ROWS = 200_000


@dataclass(frozen=True, slots=True)
class IngestResult:
    files: int
    skipped: int
    parsed: int
    ok: int
    errors: int
    full: bool
    total_rows: int
    parse_sec: float
    total_sec: float
    error_samples: tuple[str, ...]
    version: str
    write_sec: float = 0.0
    table_bytes: int = 0

    def line(self) -> str:
        """The run as one line of JSON."""
        return json.dumps(asdict(self), ensure_ascii=False, separators=(",", ":"))


def _empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def _touched(keys: DataFrame) -> list[int]:
    """The buckets of keys: at most as many numbers as there are buckets."""
    return [r[0] for r in keys.select(BUCKET).distinct().collect()]


def run_ingest(
    spark: SparkSession, json_dir: str, out_dir: str, limit: int | None = None, full: bool = False, on_event: Callable[[str], None] | None = None, stop: threading.Event | None = None
) -> IngestResult:
    """Bring the table under out_dir up to date with json_dir.

    Only new or changed files are read, by path, and only the buckets of the table and of the manifest that they touch are
    written. A file that cannot be read or is not valid is counted, keeps its old row and entry, and is tried again next
    time. Two files with one key: the last file name wins, everywhere. If a file's key has changed, its old row goes,
    unless another file still holds that key. Rows of deleted files stay until a full run, which starts from nothing; so
    does a run without a readable manifest. A full run with a limit holds those files only. stop: set it from another
    thread to cancel the run and its Spark jobs (Cancelled); nothing is committed then.
    """
    with cancellable(spark, stop):
        return _run(spark, json_dir, out_dir, limit, full, on_event or (lambda _m: None))


def _run(spark: SparkSession, json_dir: str, out_dir: str, limit: int | None, full: bool, say: Callable[[str], None]) -> IngestResult:
    began = time.monotonic()
    store = Snapshots(spark, out_dir)
    now = None if full else store.current()
    if now is not None:
        try:
            manifest, buckets = store.read("manifest"), int(now["n_buckets"])
        except Exception:  # noqa: BLE001 - one decision: what cannot be read is rebuilt
            now = None
    whole = now is None
    if whole:
        manifest = spark.createDataFrame([], _MANIFEST)
    root = json_dir.rstrip("/")
    try:
        state = materialise(compared(list_inputs(spark, json_dir, limit).withColumn("root_dir", F.lit(root)), manifest, time="mtime_us"))
    except ValueError:
        raise
    except Exception as e:  # noqa: BLE001
        raise IngestError(f"{json_dir} cannot be listed: {e}") from e
    todo = state.filter("not same").drop("same")
    n_files, n_todo = state.agg(F.count(F.lit(1)), F.count_if(~F.col("same"))).first()
    say(f"{n_files} files, {n_todo} to parse")
    if not n_todo and not whole:
        return IngestResult(n_files, n_files, 0, 0, 0, False, store.rows("jobs"), 0.0, time.monotonic() - began, (), now["version"], 0.0, 0)
    started = time.monotonic()
    parsed = materialise(parse_paths(todo, n_todo, _FILE))
    counts = parsed.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("bad")).first()
    samples = tuple(r[0] for r in parsed.filter("error is not null").orderBy("file_name").limit(SAMPLES).select("error").collect()) if counts["bad"] else ()
    if counts["ok"] + counts["bad"] != n_todo:
        raise IngestError(f"{n_todo} files were selected, {counts['ok'] + counts['bad']} came back")
    parse_sec, started = time.monotonic() - started, time.monotonic()
    if not counts["ok"] and not whole:  # only files that failed before were tried again, in vain
        return IngestResult(n_files, n_files - n_todo, n_todo, 0, counts["bad"], False, store.rows("jobs"), parse_sec, time.monotonic() - began, samples, now["version"])
    if whole:
        buckets = max(spark.sparkContext.defaultParallelism, -(-counts["ok"] // BUCKET_ROWS))
    good = parsed.filter("error is null").select(*_FILE, "row.*")
    entries = materialise(good.select(*_FILE, KEY).join(todo.select(*_FILE, "mtime_us", "size_bytes"), _FILE).withColumn(BUCKET, bucket(_FILE, buckets)))
    # the last file of a key wins: found on names and keys, so that wide rows move once, to their bucket
    last = entries.groupBy(KEY).agg(F.max("file_name").alias("_last"))
    beaten = entries.join(last, KEY).filter(F.col("file_name") < F.col("_last")).select("file_name")
    rows = small_join(good, beaten, ["file_name"], "left_anti").select(*JOBS.names, bucket([KEY], buckets))
    if whole:
        tables = {"jobs": (rows.repartition(buckets, BUCKET), None), "manifest": (entries.repartition(buckets, BUCKET), None)}
    else:
        own = entries.select(*_FILE)
        # keys that a re-read file no longer has and no other file holds
        old = manifest.join(entries.select(*_FILE, F.col(KEY).alias("_new")), _FILE).filter(F.col(KEY) != F.col("_new")).select(KEY).distinct()
        left = manifest.join(own, _FILE, "left_anti").select(KEY).unionByName(entries.select(KEY))
        replaced = materialise(old.join(left, KEY, "left_anti").unionByName(entries.select(KEY)).distinct().withColumn(BUCKET, bucket([KEY], buckets)))
        of_files, of_keys = _touched(entries), _touched(replaced)
        kept = store.read("manifest", of_files).join(own, _FILE, "left_anti").withColumn(BUCKET, bucket(_FILE, buckets))
        base = small_join(store.read("jobs", of_keys), replaced.select(KEY), [KEY], "left_anti")
        merged = base.select(*JOBS.names, bucket([KEY], buckets)).unionByName(rows)
        tables = {"jobs": (merged.repartition(max(1, len(of_keys)), BUCKET), of_keys), "manifest": (kept.unionByName(entries.select(*kept.columns)).repartition(max(1, len(of_files)), BUCKET), of_files)}
    record = store.commit(tables, {"full": whole, "n_buckets": buckets})
    say(f"committed {record['version']}")
    total, size = store.rows("jobs"), store.info()["bytes"]
    return IngestResult(n_files, n_files - n_todo, n_todo, counts["ok"], counts["bad"], whole, total, parse_sec, time.monotonic() - began, samples, record["version"], time.monotonic() - started, size)


def report(result: IngestResult) -> str:
    """Stages with their seconds and rows a second, counts, and the table's size, as text."""
    rate = lambda n, s: f"{n / s:,.0f}" if s > 0 else "-"
    stages = [("parse + validate", result.parse_sec), ("write", result.write_sec), ("total", result.total_sec)]
    lines = [("stage", "sec", "rows/s"), *((name, f"{s:.2f}", rate(result.parsed, s)) for name, s in stages)]
    counts = f"{result.ok} ok, {result.errors} errors, {result.skipped} skipped, {result.total_rows} rows, {megabytes(result.table_bytes)}"
    return "\n".join(f"{a:<18}{b:>10}{c:>12}" for a, b, c in lines) + "\n" + counts
