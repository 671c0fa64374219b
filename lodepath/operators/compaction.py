"""Consolidation of many tiny files into few well-sized ones, each record exactly once.

The steps work on a frozen manifest: the files listed at the start, whatever arrives later. Files are
read once for a digest of their JSON value; those that hold nothing readable, or a value that a file
with a smaller id holds, are left out. The rest is packed into bins by first-fit decreasing, each bin
is rewritten as one file, counts and checksums are verified, and the result is committed by one rename.
"""

from __future__ import annotations

import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IngestError
from ..functions.jsontext import record_digest
from ..session import fits, materialise, spread
from ..sources.snapshot import put_text

#: Files that one task packs; a shard holds about so many whatever the directory they are in.
SHARD_FILES = 50_000
#: Bytes that are unzipped at once.
BLOCK = 1 << 16
#: Tasks that write bins; each writes its bins one after the other.
MAX_TASKS = 20_000


def gunzip(data: bytes | None) -> bytes | None:
    """What can be unzipped from data, also from a file cut short, with garbage behind it or a wrong checksum; None if nothing can."""
    if not data:
        return None
    out, rest = [], data
    while rest[:2] == b"\x1f\x8b":
        z, at, step, broken = zlib.decompressobj(31), 0, BLOCK, False
        while at < len(rest) and not z.eof:
            before = z.copy()
            try:
                out.append(z.decompress(rest[at : at + step]))
                at += step
            except zlib.error:  # again from the same state in smaller steps, so that nothing before the error is lost
                broken = step == 1
                if broken:
                    break
                z, step = before, max(1, step // 16)
        if broken or not z.eof:
            break
        rest = z.unused_data + rest[at:]
    return b"".join(out) if out else None


def _digest_files(batches):
    schema = pa.schema([("file_id", pa.int64()), ("digest", pa.binary())])
    for batch in batches:
        got = []
        for data in batch.column(1):
            raw = gunzip(data.as_py())
            got.append(record_digest(raw) if raw is not None else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], schema=schema)


def digests(files: DataFrame) -> DataFrame:
    """(file_id, digest) of files with file_id and content; the digest is null if no complete JSON object can be unzipped."""
    return spread(files.select(F.col("file_id").cast("long"), F.col("content").cast("binary"))).mapInArrow(_digest_files, "file_id long, digest binary")


def redundant(digested: DataFrame) -> DataFrame:
    """(file_id) of the files that can be left out: unreadable ones, and copies of a file with a smaller id.

    The first file of each value is found by a partially aggregated min, so a value that a third of all files
    share moves one row per task. A null content is unreadable; an empty table gives no rows; a file listed
    twice under one id counts once.
    """
    kept = digested.filter("digest is not null").groupBy("digest").agg(F.min("file_id").alias("file_id")).select("file_id")
    # merged, not broadcast: ids compress so well that the planner would take a large side for a small one
    return digested.select("file_id").distinct().join(kept.hint("merge"), "file_id", "left_anti")


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item: the first bin with room, items by falling size; an item above the capacity gets a bin of its own.

    A segment tree over the bins' free space finds the first bin that fits in O(log n).
    """
    n = 1
    while n < max(1, len(sizes)):
        n *= 2
    tree = [0] * (2 * n)
    bins, out = 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        if tree[1] < s or (s == 0 and not bins):
            at = n + bins
            bins += 1
            tree[at] = max(0, capacity - s)
        else:
            at = 1
            while at < n:
                at = 2 * at if tree[2 * at] >= s else 2 * at + 1
            at = min(at, n + bins - 1)
            tree[at] -= s
        out[i] = at - n
        at //= 2
        while at:
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
            at //= 2
    return out


def _shards(n_files: int) -> int:
    return max(1, -(-n_files // SHARD_FILES))


def _shard(shards: int):
    return F.pmod(F.xxhash64("file_id"), F.lit(shards)).cast("int")


def plan_bins(manifest: DataFrame, capacity: int) -> DataFrame:
    """(file_id, size_bytes, bin) of a manifest with file_id and size_bytes, bins of at most `capacity` bytes.

    Packing is done per shard of about SHARD_FILES files, cut by a hash of the id, so no task holds more
    whatever the directories' sizes; each shard wastes at most about half of one bin beyond first-fit
    decreasing. Null and negative sizes count as 0.
    """
    files = manifest.select("file_id", F.greatest(F.coalesce(F.col("size_bytes"), F.lit(0)), F.lit(0)).cast("long").alias("size_bytes"))
    shards = _shards(files.count())

    def pack(key, pdf):
        pdf = pdf.sort_values("file_id", ignore_index=True)
        pdf["bin"] = [f"{key[0]:06d}-{b:06d}" for b in first_fit_decreasing(pdf["size_bytes"].tolist(), capacity)]
        return pdf[["file_id", "size_bytes", "bin"]]

    return files.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(pack, "file_id long, size_bytes long, bin string")


def _checksum(df: DataFrame) -> tuple[int, str]:
    """Rows, and an order-free sum over the digests of all rows."""
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("digest", "file_id").cast("decimal(38,0)"))).first()
    return int(r[0]), str(r[1] or 0)


def _write_bins(rows: DataFrame, path: str) -> None:
    rows.sortWithinPartitions("bin", "file_id").write.partitionBy("bin").option("compression", "zstd").parquet(path)


def compact(files: DataFrame, out_dir: str, capacity: int = 128 << 20) -> dict:
    """Rewrite files (file_id, file_name, size_bytes, content) into out_dir, one Parquet file per bin; returns the commit record.

    The manifest is frozen first: it is written with the digests and all later steps read it. Rows go to a
    staging folder; what was written is read again and compared in count and checksum with the manifest, and only then
    the folder is renamed to its version and CURRENT is replaced by one rename. A failure before leaves the earlier version in place.
    """
    spark = files.sparkSession
    frozen = materialise(digests(files))
    keep = frozen.filter("digest is not null").groupBy("digest").agg(F.min("file_id").alias("file_id"))
    keep = materialise(keep.join(files.select("file_id", "file_name", "size_bytes").dropDuplicates(["file_id"]), "file_id"))
    bins = materialise(plan_bins(keep, capacity))
    n_bins = bins.select("bin").distinct().count()
    version = f"v-{uuid.uuid4().hex}"
    staging = f"{out_dir}/_staging-{version}"
    plan = materialise(bins.select("file_id", "bin").join(keep.select("file_id", "digest"), "file_id"))
    own = files.select("file_id", "file_name", "content")
    # Contents move once. A plan of checked size goes to them, and they are parted by bin. A larger one meets them in the
    # shards that bins were packed in: the shard follows from the id, so both sides are parted by it and joined in place.
    if fits(plan):
        rows = own.join(F.broadcast(plan), "file_id").repartition(min(max(1, n_bins), MAX_TASKS), "bin").dropDuplicates(["bin", "file_id"])
        _write_bins(rows, staging)
    else:
        shards = _shards(keep.count())
        key = "spark.sql.requireAllClusterKeysForCoPartition"
        known = spark.conf.get(key)
        spark.conf.set(key, "false")
        try:
            tasks = min(shards, MAX_TASKS)
            a, b = (x.withColumn("shard", _shard(shards)).repartition(tasks, "shard") for x in (own, plan))
            _write_bins(a.dropDuplicates(["shard", "file_id"]).join(b.hint("merge"), ["shard", "file_id"]).drop("shard"), staging)
        finally:
            spark.conf.set(key, known)
    want, got = _checksum(keep), (0, "0")
    if want[0]:
        again = digests(spark.read.parquet(staging)).filter("digest is not null")
        got = _checksum(again)
    if got != want:
        raise IngestError(f"compaction: wrote {got}, expected {want}; nothing was committed")
    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{out_dir}/{p}")
    fs = path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(path(f"_staging-{version}"), path(version)):
        raise IngestError("compaction: the staging folder could not be renamed")
    record = {"version": version, "rows": want[0], "checksum": want[1], "bins": n_bins, "left_out": frozen.count() - want[0]}
    put_text(spark, f"{out_dir}/CURRENT", json.dumps(record))
    return record


_EMPTY = "file_id long, file_name string, content binary, bin string"


def written_bins(spark: SparkSession, out_dir: str, version: str) -> DataFrame:
    """(bin, rows, bytes, checksum) of a committed version, from what stands in its files; no rows if all was left out.

    bytes are those of the contents; checksum is the order-free sum of compact()'s verification, as text.
    """
    bins = spark.read.schema(_EMPTY).parquet(f"{out_dir}/{version}")
    read = bins.select("file_id", "bin", F.octet_length("content").alias("size")).join(digests(bins), "file_id")
    total = F.sum(F.xxhash64("digest", "file_id").cast("decimal(38,0)")).cast("string")
    return read.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), total.alias("checksum"))


def bin_report(bins: DataFrame, capacity: int) -> DataFrame:
    """(bin, files, bytes, fill) of a plan."""
    return bins.groupBy("bin").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")).withColumn("fill", F.col("bytes") / F.lit(float(capacity)))
