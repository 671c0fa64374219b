"""Versioned tables with one commit point.

A table is cut into buckets by a hash of its key. A version is a folder with the buckets that a run has rewritten;
CURRENT says for each bucket of each table which version holds it and how many rows, and is replaced by one rename.
So a run writes what it changes and nothing else. Readers resolve CURRENT and then read files that never change: a
writer never blocks them, and a run that dies before the rename leaves the earlier state in place. Thus no marker of
unfinished runs is needed.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import IngestError, StatsUnavailable


#: The column that names a row's bucket while it is written.
BUCKET = "_bucket"


def bucket(key: list[str], buckets: int) -> Column:
    """The bucket of a row, from 0."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias(BUCKET)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place by one rename that replaces what stands there: readers see the old text or the new one, never neither."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    new = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(new, target, how)
    except Exception as e:  # noqa: BLE001
        fs.delete(new, False)
        raise IngestError(f"{path} could not be replaced: {e}") from e


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def current(self) -> dict | None:
        """The record of the current version; None if there is none or it cannot be read."""
        fs, p = self._fs(), self._path("CURRENT")
        try:
            if not fs.exists(p):
                return None
            stream = fs.open(p)
            try:
                text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            return json.loads(text)
        except Exception:  # noqa: BLE001 - unreadable counts as absent; the next run rebuilds
            return None

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table of the current version, or some of its buckets; StatsUnavailable if there is none."""
        now = self.current()
        if now is None:
            raise StatsUnavailable(f"no snapshot under {self.root}")
        try:
            held = now["tables"][name]
            schema = StructType.fromJson(held["schema"])
            chosen = {str(b) for b in buckets} if buckets is not None else held["buckets"].keys()
            paths = [f"{self.root}/{version}/{name}/{BUCKET}={b}" for b, (version, _) in held["buckets"].items() if b in chosen]
            return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        except Exception as e:  # noqa: BLE001
            raise StatsUnavailable(f"snapshot {now.get('version')} cannot be read: {e}") from e

    def rows(self, name: str) -> int:
        """How many rows a table has, from the record alone."""
        now = self.current()
        if now is None:
            raise StatsUnavailable(f"no snapshot under {self.root}")
        return sum(n for _, n in now["tables"][name]["buckets"].values())

    def commit(self, tables: dict[str, tuple[DataFrame, list[int] | None]], record: dict) -> dict:
        """Write buckets of a new version, then make it the current one; returns the whole record.

        tables: for each table its rows with their bucket in the column BUCKET, and the buckets that these rows replace;
        None: all of them. Rows of other buckets are not allowed. Rows are counted in the files' footers.
        """
        version, known = f"v-{uuid.uuid4().hex}", (self.current() or {}).get("tables", {})
        held = {}
        for name, (df, replaced) in tables.items():
            path = f"{self.root}/{version}/{name}"
            df.write.partitionBy(BUCKET).option("compression", "zstd").parquet(path)
            kept = {} if replaced is None else {b: v for b, v in known.get(name, {}).get("buckets", {}).items() if int(b) not in set(replaced)}
            schema = df.drop(BUCKET).schema
            written = self.spark.read.schema(StructType([*schema.fields, df.schema[BUCKET]])).parquet(path)
            counts = {str(r[0]): [version, r[1]] for r in written.groupBy(BUCKET).agg(F.count(F.lit(1))).collect()}
            if kept.keys() & counts.keys():
                raise IngestError(f"{name}: rows of buckets that are not replaced: {sorted(kept.keys() & counts.keys())}")
            held[name] = {"schema": schema.jsonValue(), "buckets": kept | counts}
        record = record | {"version": version, "tables": held}
        put_text(self.spark, f"{self.root}/CURRENT", json.dumps(record))
        return record

    def info(self) -> dict:
        """Version, bytes and rows of the table, entries of the manifest and when it was written; Nones if there is no snapshot.

        Entries of deleted inputs stay, so there may be more of them than files.
        """
        now, fs = self.current(), self._fs()
        out = dict.fromkeys(("version", "bytes", "rows", "manifest_entries", "written_at"))
        if now is None:
            return out
        folders = {f"{version}/{name}/{BUCKET}={b}" for name, t in now["tables"].items() for b, (version, _) in t["buckets"].items()}
        size = sum(fs.getContentSummary(self._path(f)).getLength() for f in folders)
        out |= {"version": now["version"], "bytes": size, "rows": self.rows("jobs"), "manifest_entries": self.rows("manifest")}
        out["written_at"] = datetime.fromtimestamp(fs.getFileStatus(self._path("CURRENT")).getModificationTime() / 1000, timezone.utc).strftime("%Y-%m-%d %H:%M")
        return out

    def expire(self, keep: int = 2) -> list[str]:
        """Delete all but the newest versions; never one that the current state still has buckets in."""
        fs, now = self._fs(), self.current()
        found = [s for s in fs.listStatus(self._path("")) if s.getPath().getName().startswith("v-")] if fs.exists(self._path("")) else []
        found.sort(key=lambda s: -s.getModificationTime())
        used = {version for t in (now or {}).get("tables", {}).values() for version, _ in t["buckets"].values()} | {(now or {}).get("version")}
        gone = [s.getPath() for s in found[keep:] if now is not None and s.getPath().getName() not in used]
        for p in gone:
            fs.delete(p, True)
        return [p.getName() for p in gone]
