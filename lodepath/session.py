"""Sessions, the shared folder, tables cut from their lineage, and joins with a side of checked size."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Cancelled

#: Rows up to which a side may be broadcast; joins with more use a salted shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of values, as text, up to which a side may be broadcast: rows may be of any width.
BROADCAST_BYTES = 32 << 20
#: Copies of the smaller side in a salted join.
SALTS = 16

_written: list[tuple[SparkSession, str]] = []


def session(app: str = "lodepath", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results depend on (UTC) and adaptive execution."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a new folder in local mode; an error on a cluster, whose machines share none by themselves."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set: {sc.master} needs a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodepath-"))
        at = sc.getCheckpointDir()
    return at


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone, and with it the folder
        pass


def release(since: int = 0) -> None:
    """Delete every table written by materialise() and every shared_folder(), or those since the first so many; results that read them are unusable afterwards."""
    while len(_written) > since:
        _delete(*_written.pop())


atexit.register(release)


@contextmanager
def scratch():
    """A block at whose end the tables written within it are deleted: for long sessions, around a query and the use of its result."""
    since = len(_written)
    try:
        yield
    finally:
        release(since)


@contextmanager
def cancellable(spark: SparkSession, stop: threading.Event | None):
    """A block whose Spark jobs are cancelled when stop is set by another thread; the block then ends with Cancelled."""
    if stop is None:
        yield
        return
    sc, tag, done = spark.sparkContext, f"lodepath-{uuid.uuid4().hex}", threading.Event()

    def watch():
        while not done.is_set():
            if stop.wait(0.2):
                while not done.wait(0.2):  # jobs that start meanwhile go as well
                    sc.cancelJobsWithTag(tag)
                return

    watcher = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    watcher.start()
    try:
        if stop.is_set():
            raise Cancelled("cancelled")
        yield
    except Exception as e:
        if stop.is_set():
            raise Cancelled("cancelled") from e
        raise
    finally:
        done.set()
        sc.removeJobTag(tag)
        watcher.join()


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's path in the shared folder, which release() deletes as well."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, computes df once however
    often the result is used, and gives the planner true sizes. An empty df keeps its schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df = df.select(*keep) if keep else df
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for work that costs far more than moving the rows.

    Only a plain scan of few partitions is moved: small or unsplittable files. Anything larger, and any plan with a
    shuffle of its own, stays as it is.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString() or execution.toRdd().getNumPartitions() >= want:
        return df
    return df.repartition(want)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows, and so many bytes in them as text; reads no more than rows + 1 of them."""
    # widths are taken below the limit: only these move to the task that adds them up
    names = [f"`{c.replace('`', '``')}`" for c in df.columns]
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in names), F.lit(0).cast("long"))
    n, total = df.select(width.alias("width")).limit(rows + 1).agg(F.count(F.lit(1)), F.sum("width")).first()
    return n <= rows and (total or 0) <= size


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large left side, whose keys may be skewed, to a right side that is expected to be small.

    If right has at most `rows` rows and BROADCAST_BYTES, it is broadcast. Beyond that, left gets a random salt and
    right is copied once per salt, so that no key stays in one task. `how`: inner, left, left_semi, left_anti.
    """
    if fits(right, rows):
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", (F.rand(7) * SALTS).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # the planner takes the copies for as small as the packed file they come from, and would send them all through the driver
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


