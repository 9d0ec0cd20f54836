"""Shared storage for lineage cuts, and session settings of the Python stages."""

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch, the same for all operators, so that batches of long texts stay small.
BATCH_ROWS = 1000

_SCOPES: list[list[str]] = []
_CLEARED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, deleted when the driver ends or clear() is called.

    Where that is unset, a temporary one in local mode (tests); on a cluster an error, since executors do not share the
    driver's disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = checkpoint.get() if checkpoint.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quorumlake-")
        spark.sparkContext.setCheckpointDir(found)
    path = f"{found.rstrip('/')}/quorumlake-{spark.sparkContext.applicationId}"
    if path not in _CLEARED:
        _CLEARED.add(path)
        atexit.register(_quietly, spark, path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df cut from its lineage: written once as Parquet in the shared folder and read back.

    What it holds is fixed by the write, so that later jobs, retries and lost executors all see the same rows,
    even where df numbers its partitions. The write's shuffle files go at its end: else they stay on the executors' disks
    until the driver happens to collect its garbage.
    """
    path = new_path(df.sparkSession, name)
    with _set(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quorumlake_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes what written() has made: tables that nothing reads any more, not even to make a lost part again."""
    for table in tables:
        if path := getattr(table, "_quorumlake_path", None):
            _delete(table.sparkSession, path)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Tables written inside are deleted at its end, but for those given to the function that it yields."""
    _SCOPES.append([])
    keep: list[str] = []
    try:
        yield lambda table: keep.append(table._quorumlake_path)
    finally:
        for path in _SCOPES.pop():
            if path not in keep:
                _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written in the shared folder. Results that were not written or read need it no more."""
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _quietly(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped
        _delete(spark, path)


def small_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows in an Arrow batch of this session from now on; a smaller number that is set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@contextlib.contextmanager
def _set(spark: SparkSession, name: str, value: str):
    """A setting of the jobs that run inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def batch_rows(spark: SparkSession, rows: int):
    """So many rows in an Arrow batch of the jobs that run inside."""
    return _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fit_partitions(df: DataFrame, minimum: int = 1) -> int:
    """Partitions for a shuffle of df's rows: spark.sql.shuffle.partitions, which the cluster's owner sizes."""
    return max(minimum, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def own_names(columns: list[str], *names: str) -> list[str]:
    """names, changed until none is among columns in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out
