"""Where tables go besides the snapshot: Parquet, JSON lines, SQLite, Arrow IPC."""

from __future__ import annotations

import contextlib
import gzip
import json
import os
import sqlite3
from itertools import batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import IngestError, ScrapeError
from ..functions.text import raw_filename
from ..schema import KEY
from ..session import spread
from .storage import placed

#: What a page must hold, and which of it a search hit can supply.
REQUIRED = "id board_token source apply_url source_and_board_token requisition_id collapse_key is_expired objectID job_information v5_processed_job_data".split()
HIT_NAMES = {k: (k,) for k in REQUIRED[:9]} | {"apply_url": ("apply_url", "hc_apply_url")}


def write_parquet(df: DataFrame, path: str, files: int | None = None) -> None:
    """Parquet with zstd; in so many files, if said."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_sqlite(df: DataFrame, path: str, table: str = "jobs", key: str = KEY, replace: bool = True, stale: DataFrame | None = None, batch: int = 1000) -> int:
    """Rows into a SQLite file, in one transaction; returns the rows it holds. Rows pass through the driver, one partition at a time.

    With replace the file is made anew; else the rows whose keys stand in stale (its column key) go first, and rows
    with an equal key are replaced. A failure leaves the rows as they were.
    """
    if replace:
        for end in ("", "-wal", "-shm"):
            with contextlib.suppress(FileNotFoundError):
                os.unlink(path + end)
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "double": "REAL"}
    columns = ", ".join(f'"{c}" {kinds.get(t, "TEXT")}' + (" PRIMARY KEY" if c == key else "") for c, t in df.dtypes)
    marks = ", ".join("?" * len(df.columns))
    with contextlib.closing(sqlite3.connect(path)) as con, con:
        con.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({columns})')
        if stale is not None:
            for part in batched(stale.select(key).toLocalIterator(), batch):
                con.executemany(f'DELETE FROM "{table}" WHERE "{key}" = ?', map(tuple, part))
        for part in batched(df.toLocalIterator(), batch):
            con.executemany(f'INSERT OR REPLACE INTO "{table}" VALUES ({marks})', map(tuple, part))
        return con.execute(f'SELECT count(*) FROM "{table}"').fetchone()[0]


def read_sqlite(spark: SparkSession, path: str, schema: str, table: str = "jobs") -> DataFrame:
    """A table of a SQLite file as rows of the given schema, read by one task; the file must be where executors see it."""
    names = spark.createDataFrame([], schema).columns

    def run(batches):
        for _ in batches:
            with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
                cursor = con.execute("SELECT " + ", ".join(f'"{c}"' for c in names) + f' FROM "{table}"')
                while part := cursor.fetchmany(10_000):
                    yield pd.DataFrame(part, columns=names, dtype=object)

    return spark.range(1).coalesce(1).mapInPandas(run, schema)


def write_ipc(df: DataFrame, path: str, batch: int = 10_000) -> int:
    """One Arrow IPC file for a hand-off; returns its rows. Batches pass through the driver, one partition at a time."""
    schema, rows = to_arrow_schema(df.schema), 0
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, schema) as out:
        for part in batched(df.toLocalIterator(), batch):
            out.write_batch(pa.RecordBatch.from_pylist([r.asDict() for r in part], schema=schema))
            rows += len(part)
    return rows


def read_ipc(path: str, rows: int) -> pa.Table:
    """A hand-off file, which is deleted; IngestError unless it holds so many rows."""
    try:
        with pa.memory_map(path) as f:
            data = pa.ipc.open_file(f).read_all()
    except (OSError, pa.ArrowInvalid) as e:
        raise IngestError(f"{path} cannot be read: {e}") from e
    os.unlink(path)
    if data.num_rows != rows:
        raise IngestError(f"{path} holds {data.num_rows} rows, expected {rows}")
    return data


def missing_keys(job: dict) -> list[str]:
    """What a page lacks, sorted."""
    return sorted(k for k in REQUIRED if job.get(k) is None)


def with_identity(detail: dict, hit: dict | None) -> dict:
    """The page with the identity fields it lacks taken from the search hit: the first of a field's names that the hit has."""
    have, hit = {k for k, v in detail.items() if v is not None}, hit or {}
    supplied = {k: next((hit[n] for n in HIT_NAMES[k] if hit.get(n) is not None), None) for k in HIT_NAMES if k not in have}
    return detail | {k: v for k, v in supplied.items() if v is not None}


def page_bytes(job: dict) -> bytes:
    """A posting's page as a gzipped document, the same bytes whenever it is made."""
    return gzip.compress(json.dumps({"pageProps": {"job": job}, "__N_SSG": True}, ensure_ascii=False).encode("utf-8", "surrogatepass"), mtime=0)


def write_raw_page(detail: dict, raw_dir: str, hit: dict | None = None) -> str | None:
    """One page as a gzipped file of raw_dir, on any file system; None if it would not validate.

    The file is there as a whole or not at all; ScrapeError if it cannot be written.
    """
    job = with_identity(detail, hit)
    name = raw_filename(str(job[KEY])) if not missing_keys(job) else None
    if name is None:
        return None
    target = f"{raw_dir.rstrip('/')}/{name}"
    try:
        body = page_bytes(job)
        with placed(target) as out:
            out.write(body)
    except (OSError, TypeError, ValueError) as e:
        raise ScrapeError(f"{name} cannot be written: {e}") from e
    return target


def write_files(files: DataFrame, folder: str, name: str = "file_name", content: str = "content") -> int:
    """The contents of rows as files of a folder that executors share, written by the tasks that hold them; returns their number.

    Two rows of one name: one of them stays, whichever task comes last; a null content is an empty file.
    """

    def run(batches):
        for batch in batches:
            for n, data in zip(batch.column(0), batch.column(1), strict=True):
                with placed(f"{folder}/{n.as_py()}") as out:
                    out.write(data.as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return int(spread(files.select(name, content)).mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0)
