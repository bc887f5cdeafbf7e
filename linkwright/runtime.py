"""Session helpers: the shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "linkwright", **conf) -> SparkSession:
    """A session with adaptive execution on; what `conf` holds goes on top."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset on a local master, as in
    tests, a temporary folder is set once per application; on a cluster that is an error, as executors could not read it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="linkwright-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


_scratch: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/linkwright-{uuid.uuid4().hex}-{tag}"
    if not _scratch:
        atexit.register(_clean)
    _scratch.append(path)
    return path


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _scratch if spark else ():
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark can reach; a missing one is no error."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception as e:  # the gateway may be gone when the driver ends
        print(f"linkwright: {path} was not deleted: {type(e).__name__}")


#: Spark's setting by which the shuffle files of an action are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back. Unlike a local checkpoint, it
    outlives the executors that computed it, and later steps do not compute it again."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the shuffles behind the table are not read again, so they go as soon as it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    out = spark.read.schema(df.schema).parquet(path)
    out._linkwright_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what `materialize` wrote, once nothing reads it any more."""
    path = getattr(df, "_linkwright_path", None)
    if path:
        remove(df.sparkSession, path)
        if path in _scratch:
            _scratch.remove(path)


def apart(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that is shuffled and sorted, never broadcast. Spark guesses the size of a table from its files and does not see
    that rows were multiplied or strings made, so a table of millions of rows counts as few MB and the driver would have to hold it."""
    return df.hint("merge")
