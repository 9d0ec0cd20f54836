"""Streams: the sliding-log limiter over usage events, and incremental import of landed files."""

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The configured limits: seconds of the window and calls in it.
USER_LIMIT = (600, 5)
GUEST_LIMIT = (86400, 5)


def admit(log: list[int], us: int, window_us: int, most: int) -> tuple[bool, list[int]]:
    """One call at a time in microseconds: whether it is admitted, and the log after it."""
    recent = [t for t in log if t > us - window_us]
    return (True, [*recent, us]) if len(recent) < most else (False, recent)


def admission_stream(events: DataFrame, key: str, ts: str, event_id: str, window_s: int, most: int, late: str = "1 hour") -> DataFrame:
    """event_id, key, ts and admitted of each event, in the order of time, whatever order events come in and by how many triggers.

    An event waits in its key's state until the watermark has reached it, so that none before it can still come, and is then
    judged; one that comes later than the watermark allows is dropped by Spark. State is a key's admitted times inside the
    window, `most` at most, and the events of the last `late`; it is dropped once the watermark has passed the window.
    Events after the last watermark wait for what moves it on.
    """
    window_us = window_s * 1_000_000
    out = f"{event_id} long, {key} string, {ts} timestamp, admitted boolean"

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log, waiting = [], []
        if state.exists:
            log, times, ids = (list(x) for x in state.get)
            waiting = list(zip(times, ids, strict=True))
        for rows in () if state.hasTimedOut else pdfs:
            waiting += zip(rows[ts].astype("datetime64[us]").astype("int64").tolist(), rows[event_id].tolist(), strict=True)
        mark = state.getCurrentWatermarkMs()
        waiting.sort()
        found = []
        for us, number in waiting:
            if us > mark * 1000:
                break
            ok, log = admit(log, us, window_us, most)
            found.append((number, us, ok))
        waiting = waiting[len(found) :]
        if waiting or (log and log[-1] + window_us > mark * 1000):
            state.update((log, [x for x, _ in waiting], [x for _, x in waiting]))
            due = waiting[0][0] if waiting else log[-1] + window_us
            state.setTimeoutTimestamp(max(due // 1000 + 1, mark + 1))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame({event_id: [x for x, _, _ in found], key: str(k[0]), ts: pd.to_datetime([x for _, x, _ in found], unit="us"), "admitted": [x for _, _, x in found]})

    keyed = events.select(F.col(event_id).cast("long").alias(event_id), F.col(key).cast("string").alias(key), F.col(ts).cast("timestamp").alias(ts))
    return keyed.withWatermark(ts, late).groupBy(key).applyInPandasWithState(run, out, "log array<long>, times array<long>, ids array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def record_usage(verdicts: DataFrame, path: str, checkpoint: str):
    """Appends the admitted events of a stream to the usage log under path; a rejected call leaves no event. Returns when what has come is written."""
    kept = verdicts.filter("admitted").drop("admitted")
    q = kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def import_new_files(spark: SparkSession, path: str, schema, checkpoint: str, sink: Callable[[DataFrame, int], None], file_format: str = "json"):
    """Bring what has landed since the last call to sink; the checkpoint is the marker of what was imported.

    A batch that fails after its write comes again under the same number: the sink must take a number once, as once() does.
    """
    stream = spark.readStream.schema(schema).format(file_format).load(path)
    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return q


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def once(root: str) -> Callable[[DataFrame, int], None]:
    """A sink that takes each batch number once: a table of batches under root, which committed() reads.

    A batch is written into a folder of its own that nobody reads, and becomes visible by one small file that names the
    folder, created only if there is none of its number. Whatever stops a batch before that leaves a folder that no one
    names; what stops it after that finds the file when it comes again, and writes nothing.
    """

    def sink(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        fs, pointer = _fs(spark, f"{root}/batches/{number:012d}")
        if fs.exists(pointer):
            return
        folder = f"{number:012d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{root}/data/{folder}")
        # written under another name first: a pointer that exists is whole
        _, draft = _fs(spark, f"{root}/drafts/{folder}")
        stream = fs.create(draft, True)
        stream.write(bytearray(folder.encode()))
        stream.close()
        fs.mkdirs(pointer.getParent())
        if not fs.rename(draft, pointer):
            fs.delete(draft, False)
            if not fs.exists(pointer):
                raise OSError(f"cannot make batch {number} visible under {root}")

    return sink


def committed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of all batches that are visible under root, each once."""
    fs, at = _fs(spark, f"{root}/batches")
    names = [str(x.getPath().toString()) for x in fs.listStatus(at)] if fs.exists(at) else []
    if not names:
        return spark.createDataFrame([], schema)
    folders = [r.value for r in spark.read.text(names).collect()]  # a row for each batch
    return spark.read.schema(schema).parquet(*[f"{root}/data/{x}" for x in folders])
