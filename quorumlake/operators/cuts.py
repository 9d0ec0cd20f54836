"""Lineage cuts for operators that go on in rounds, and a shared folder for landed files."""

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quorumlake-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed once, as a table in the shared folder: what reads it knows its size, however many rounds came before."""
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the checkpoint folder, in its partitions and their order."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_FOLDERS: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that no other run uses, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.append((spark, path))
    return path


@atexit.register
def _delete_folders() -> None:
    for spark, path in _FOLDERS:
        with contextlib.suppress(Exception):  # the session may have been stopped
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def state_of(spark: SparkSession, *paths: str) -> tuple:
    """Names, sizes and times of the files of tables: differs if one of the tables has been written anew."""
    conf, out = spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(conf).listFiles(at, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        out.append(tuple(sorted(found)))
    return tuple(out)


def made_once(spark: SparkSession, kept: dict, name: str, tables: list[str], make) -> str:
    """A folder that make(path) has written from tables, which are paths; made again when a table's files have changed. What reads the old one goes on with it."""
    key = (spark.sparkContext.applicationId, name, *tables)
    state = state_of(spark, *tables)
    if kept.get(key, (None, None))[0] != state:
        path = new_folder(spark, name)
        make(path)
        kept[key] = (state, path)
    return kept[key][1]


#: Rows in an Arrow batch of steps that take whole texts or files.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows in an Arrow batch of this session from now on; a smaller number that is set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
