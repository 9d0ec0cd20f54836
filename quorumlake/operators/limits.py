"""Sliding-log rate limits over an event log: demand and admission."""

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from .cuts import placed

#: Events in a segment of the time line, about: what one task streams through.
SEGMENT_EVENTS = 50_000


def micros(ts: str) -> Column:
    """Microseconds of a timestamp without zone, read as UTC."""
    return F.unix_micros(F.to_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone()))


def demand(df: DataFrame, key: str, ts: str, window_s: int) -> DataFrame:
    """in_window: events of the key in the window that ends with each event, those exactly a window older not counted."""
    us = df.withColumn("_us", micros(ts))
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(-(window_s * 1_000_000 - 1), 0)
    return us.withColumn("in_window", F.count("*").over(w)).drop("_us")


class Log:
    """The admitted times inside the window, of one key at a time; `most` of them at most."""

    def __init__(self, key, times: list[int], window: int, most: int):
        self.key, self.times, self.window, self.most = key, deque(times), window, most

    def judge(self, key, at: int | None) -> tuple[bool, int, int | None]:
        """Whether an event is admitted, how many more could be, and, if not, the time until one is. A null time counts for nothing."""
        if key != self.key:
            self.key, self.times = key, deque()
        while self.times and at is not None and self.times[0] <= at - self.window:
            self.times.popleft()
        held = len(self.times) if at is not None else 0
        if held >= self.most:
            return False, 0, max(0, self.times[0] + self.window - at) if self.times else 0
        if at is not None:
            self.times.append(at)
        return True, self.most - held - 1, None


def admission(df: DataFrame, key: str, ts: str, order: str, window_s: int, most: int, segment_events: int = SEGMENT_EVENTS) -> DataFrame:
    """admitted and remaining of each event, in order of time (ties by order); rejected events are not recorded and take no place.

    The events are cut into segments by key and time, so that a key with very many spreads over tasks. What a segment decides
    depends on the log that the one before leaves to it. All segments are judged at once, from an empty log; those to whom
    the one before leaves another log are judged again, until none changes. A segment in which a whole window passes without
    events leaves the same log whatever it began with, and logs that began apart soon agree, so that few rounds do; a chain
    that never agrees takes a round for each of its segments. A log has `most` times at most; one for each segment passes
    through the driver. A null time counts for nothing and comes first.
    """
    window, names = window_s * 1_000_000, df.columns
    us = df.withColumn("_us", micros(ts)).withColumn("_key", F.col(key))
    rest = [c for c in names if c != order]
    segments = max(1, min(1 + us.count() // segment_events, 100_000))
    by = ["_key", "_us", order, *rest]
    dealt = us.repartitionByRange(segments, *by).sortWithinPartitions(*by)
    dealt = placed(dealt) if segments > 1 else dealt

    def judged(logs: dict[int, tuple], only: set[int] | None = None):
        """Each batch of a segment with its verdicts, and the log at the segment's end."""

        def run(batches: Iterator[pa.RecordBatch]):
            part = TaskContext.get().partitionId()
            if only is not None and part not in only:
                return
            log = Log(*logs.get(part, (None, [])), window, most)
            for batch in batches:
                yield log, batch, [log.judge(k, x) for k, x in zip(batch.column("_key").to_pylist(), batch.column("_us").to_pylist(), strict=True)]

        return run

    def ends(logs: dict[int, tuple], only: set[int] | None) -> list:
        """(segment, first, key, times): the key that a segment begins with, and what it leaves; a row for each segment."""
        run = judged(logs, only)

        def tell(batches):
            first = log = None
            for log, batch, _ in run(batches):
                first = batch.column("_key").slice(0, 1) if first is None and batch.num_rows else first
            if first is not None:
                found = [pa.array([TaskContext.get().partitionId()], pa.int32()), first, pa.array([log.key], first.type), pa.array([list(log.times)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(found, names=["segment", "first", "key", "times"])

        of = us.schema["_key"].dataType
        schema = StructType([StructField("segment", IntegerType()), StructField("first", of), StructField("key", of), StructField("times", ArrayType(LongType()))])
        return dealt.select("_key", "_us").mapInArrow(tell, schema).collect()

    logs: dict[int, tuple] = {}
    left: dict[int, tuple] = {}
    firsts: dict[int, object] = {}
    only: set[int] | None = None
    while segments > 1:
        for r in ends(logs, only):
            left[r.segment], firsts[r.segment] = (r.key, list(r.times)), r.first
        given, passed = {}, (None, [])
        for part in sorted(left):  # an empty segment hands on what it was given
            given[part], passed = passed, left[part]
        # a segment that begins with another key begins with an empty log
        only = {part for part in left if given[part][0] == firsts[part] and given[part][1] != logs.get(part, (None, []))[1]}
        if not only:
            break
        logs = given
    run = judged(logs)

    def verdicts(batches):
        for _, batch, found in run(batches):
            admitted, remaining, retry = zip(*found, strict=True) if found else ((), (), ())
            columns = [pa.array(admitted, pa.bool_()), pa.array(remaining, pa.int32()), pa.array(retry, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *columns], names=[*names, "admitted", "remaining", "retry_us"])

    schema = StructType([*df.schema.fields, StructField("admitted", BooleanType()), StructField("remaining", IntegerType()), StructField("retry_us", LongType())])
    return dealt.mapInArrow(verdicts, schema)
