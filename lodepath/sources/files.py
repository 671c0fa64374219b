"""Directories of gzipped pages: listing, change detection, and reading and parsing by path, all on the executors."""

from __future__ import annotations

from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..schema import JOBS
from ..session import spread
from . import storage
from .validate import process

SUFFIX = ".json.gz"
#: Files that one task parses, about.
TASK_FILES = 2_000

_LISTED = pa.schema([("path", pa.string()), ("file_name", pa.string()), ("mtime_us", pa.int64()), ("size_bytes", pa.int64())])


def _list(batches):
    for batch in batches:
        for directory in batch.column(0).to_pylist():
            base = directory.rstrip("/")
            found = ((f"{base}/{name}", name, time, size) for name, time, size in storage.list_dir(directory) if name.endswith(SUFFIX))
            for part in batched(found, 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _LISTED.types, strict=True)], schema=_LISTED)


def list_inputs(spark: SparkSession, json_dir: str | list[str], limit: int | None = None) -> DataFrame:
    """(path, file_name, mtime_us, size_bytes) of the files of a directory that end in .json.gz, perhaps the first only, by name.

    Files of length 0, and names that begin with . or _, are files like any other. Contents are not read. A directory is
    listed by one task and its files never come to the driver; several directories are listed side by side.
    """
    if limit is not None and limit <= 0:
        raise ValueError(f"limit must be positive, got {limit}")
    directories = [json_dir] if isinstance(json_dir, str) else list(json_dir)
    roots = spark.createDataFrame([(d,) for d in directories], "directory string").repartition(max(1, len(directories)))
    out = roots.mapInArrow(_list, "path string, file_name string, mtime_us long, size_bytes long")
    return out.orderBy("file_name", "path").limit(limit) if limit else out


def compared(files: DataFrame, manifest: DataFrame, on: tuple[str, ...] = ("root_dir", "file_name"), time: str = "mtime_ns") -> DataFrame:
    """files with the column same: whether the manifest knows the file with that time and size."""
    known = manifest.select(*on, F.col(time).alias("_time"), F.col("size_bytes").alias("_size"))
    same = F.coalesce((F.col("_time") == F.col(time)) & (F.col("_size") == F.col("size_bytes")), F.lit(False))
    return files.join(known, list(on), "left").select(*files.columns, same.alias("same"))


def changed(files: DataFrame, manifest: DataFrame, on: tuple[str, ...] = ("root_dir", "file_name"), time: str = "mtime_ns") -> DataFrame:
    """The files that are new, or whose time or size differs from the manifest's, or is unknown."""
    return compared(files, manifest, on, time).filter("not same").drop("same")


_ROW = to_arrow_type(JOBS)
_ROW_TYPE = "row struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in JOBS) + ">, error string"


def _load(path: str) -> tuple[dict | None, str | None]:
    try:
        data = storage.read_bytes(path)
    except OSError as e:
        return None, f"read: {e}"
    return process(data)


def _parse(keys: int, one):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                done = [one(x.as_py()) for x in part.column(keys)]
                rows = pa.array([r for r, _ in done], pa.struct([f.with_nullable(True) for f in _ROW]))
                errors = pa.array([e for _, e in done], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:keys], rows, errors], names=[*part.schema.names[:keys], "row", "error"])

    return run


def _parsed(own: DataFrame, keys: list[str], one) -> DataFrame:
    kinds = dict(own.dtypes)
    return own.mapInArrow(_parse(len(keys), one), ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), _ROW_TYPE]))


def parse_content(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys..., row, error): each file's flat row, or why it has none; a null content is an error. No shuffle, unless the scan has fewer partitions than there are cores."""
    return _parsed(spread(files.select(*keys, content)), keys, process)


def parse_paths(files: DataFrame, n_files: int, keys: list[str], path: str = "path") -> DataFrame:
    """As parse_content(), of files named by path: each is opened by the task that parses it, so only names move.

    A file that cannot be opened is an error of that file. n_files: how many there are, for the number of tasks.
    """
    tasks = max(1, min(n_files, max(files.sparkSession.sparkContext.defaultParallelism, -(-n_files // TASK_FILES))))
    return _parsed(files.select(*keys, path).repartition(tasks), keys, _load)
