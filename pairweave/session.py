"""Session defaults and the shared folder used for checkpoints and work tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    app: str = "pairweave",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create a session; on a cluster leave ``master`` and memory to spark-submit."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**LOCAL_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` when it is set.

    Only a local master may fall back to a temporary folder, because there the
    driver and the executors are one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    checkpoint_dir = spark.sparkContext.getCheckpointDir()
    if checkpoint_dir:
        return checkpoint_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="pairweave-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{work_root(spark)}/pairweave-{name}-{uuid.uuid4().hex}"


_OWNED: dict[str, SparkSession] = {}


# Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage
NO_SHUFFLE_LEFT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame | list[DataFrame], name: str, keep_shuffles: bool = True) -> DataFrame:
    """Write ``df``, or several frames of one schema one after the other, once to the shared folder and scan it back.

    Used where several passes read an expensive result: the files outlive lost
    executors and the plan behind them is cut. The table belongs to this
    process: ``discard`` drops it early, and what is left goes when Python ends.
    Without ``keep_shuffles`` the shuffle files behind it go as soon as it is written.
    """
    frames = [df] if isinstance(df, DataFrame) else df
    spark = frames[0].sparkSession
    path = work_path(spark, name)
    _OWNED[path] = spark
    before = spark.conf.get(NO_SHUFFLE_LEFT, "false")
    if not keep_shuffles:
        spark.conf.set(NO_SHUFFLE_LEFT, "true")
    try:
        for frame in frames:
            frame.write.mode("append").parquet(path)
    finally:
        if not keep_shuffles:
            spark.conf.set(NO_SHUFFLE_LEFT, before)
    return spark.read.schema(frames[0].schema).parquet(path)


def own(spark: SparkSession, path: str) -> str:
    """Let ``path`` below the shared folder go with this process."""
    _OWNED[path] = spark
    return path


def discard(*tables: DataFrame | str) -> None:
    """Delete work tables, given as the frames ``materialize`` returned or as paths.

    Only paths that this process owns are deleted; a plan that still reads one of
    them must not be run any more.
    """
    for table in tables:
        paths = [table] if isinstance(table, str) else [f.rpartition("/")[0] for f in table.inputFiles()[:1]]
        for path in [p for p in _OWNED if any(q.rstrip("/").endswith(p.partition(":")[2] or p) for q in paths)]:
            spark = _OWNED.pop(path)
            jvm = spark._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextmanager
def work_scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Work tables made inside are deleted at the end, but for those passed to the given function.

    For a step whose result is stored: what it used on the way is not kept.
    """
    before, kept = set(_OWNED), set()

    def keep(table: DataFrame) -> DataFrame:
        files = [f.rpartition("/")[0].rstrip("/") for f in table.inputFiles()]
        kept.update(p for p in _OWNED if any(f.endswith(p.partition(":")[2] or p) for f in files))
        return table

    yield keep
    discard(*(set(_OWNED) - before - kept))


def _discard_all() -> None:
    for path in list(_OWNED):
        try:
            discard(path)
        except Exception:  # the JVM may be gone before us; the names tell what is left
            return


atexit.register(_discard_all)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of a few files as many tasks as there are cores.

    A scan that already has enough splits is left alone, so large inputs are
    never shuffled just to be redistributed. Meant for scans and what is
    projected or filtered from them: asking a plan with shuffles for its
    partitions would run those shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
