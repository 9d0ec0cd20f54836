"""Models' replies and calls: parsing with shape checks, injected clients, retries, progress events.

A client is a plain function, passed in and called inside tasks; without a service, a function that needs none takes its place.
"""

import hashlib
import random
import re
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .. import schemas
from ..functions.text import retry_delay_ms_of
from . import grams
from .cuts import small_batches

#: Fixed value: errors after which a call is worth repeating. A number with a fraction is an amount, such as a delay, and no status.
RETRYABLE = re.compile(r"(?<![0-9]\.)\b(?:429|500|502|503|504)\b(?!\.[0-9])|\b(UNAVAILABLE|RESOURCE_EXHAUSTED|INTERNAL|ETIMEDOUT|ECONNRESET|ECONNREFUSED|ENOTFOUND|socket hang up)\b|timed?\s*out|timeout|fetch failed", re.IGNORECASE)
RELEVANCES = ("primary", "secondary")


def with_retry(call: Callable, attempts: int = 6, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random):
    """call()'s result; errors that pass are tried again, after the delay that the message names or 1, 2, 4 … seconds, and up to half a second more."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if attempt == attempts or not RETRYABLE.search(str(e)):
                raise
            named = retry_delay_ms_of(str(e))
            sleep(((1000 * 2 ** (attempt - 1) if named is None else named) + int(jitter() * 500)) / 1000)


def is_retryable(message: Column | str) -> Column:
    return F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit("")).rlike("(?i)" + RETRYABLE.pattern)


def summary_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """df with summary, topic_digests and problem, the first fault of a summariser's JSON reply (null: none)."""
    r = df.withColumn("_r", F.from_json(reply, schemas.SUMMARY_REPLY))
    digests = F.col("_r.topic_digests")
    whole = lambda d: d["topic"].isNotNull() & d["relevance"].isin(*RELEVANCES) & d["digest"].isNotNull() & d["speakers"].isNotNull()
    problem = (
        F.when(F.col(reply).isNull() | (F.trim(reply) == ""), "empty reply")
        .when(F.col("_r").isNull() | (F.get_json_object(reply, "$").isNull()), "not JSON")
        .when(F.col("_r.summary").isNull(), "no summary")
        .when(digests.isNull(), "no topic_digests")
        .when(~F.forall(digests, lambda d: F.coalesce(whole(d), F.lit(False))), "a topic lacks a field")
    )
    r = r.withColumn("problem", problem)
    good = F.col("problem").isNull()
    return r.select(*df.columns, F.when(good, F.col("_r.summary")).alias("summary"), F.when(good, digests).alias("topic_digests"), "problem")


def cluster_replies(df: DataFrame, municipality: str = "municipality_code", reply: str = "reply") -> DataFrame:
    """A row for each member of each cluster in a clusterer's JSON reply: municipality, canonical_name, description, position, member_index. Clusters without a name or members give none."""
    c = df.select(municipality, F.posexplode(F.from_json(reply, schemas.CLUSTERS)["clusters"]).alias("position", "c")).filter("c.canonical_name is not null")
    return c.select(municipality, F.col("c.canonical_name").alias("canonical_name"), F.coalesce("c.description", F.lit("")).alias("description"), F.col("position").cast("long").alias("position"), F.explode("c.member_indices").alias("member_index"))


def summarise(meetings: DataFrame, client: Callable[[str, str], str], key: str = "id", title: str = "title", transcript: str = "transcript") -> DataFrame:
    """key and reply of each meeting: client(title, transcript) in tasks, with retries; a call that fails for good gives error in place of reply."""

    def run(frames):
        for pdf in frames:
            out = []
            for k, t, text in zip(pdf[key], pdf[title], pdf[transcript], strict=True):
                try:
                    out.append((k, with_retry(lambda t=t, text=text: client(t, text)), None))
                except Exception as e:  # noqa: BLE001  an error is data: other meetings go on
                    out.append((k, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "reply", "error"])

    kind = meetings.schema[key].dataType.simpleString()
    return meetings.select(key, title, transcript).mapInPandas(run, f"{key} {kind}, reply string, error string")


def leading_lines(title: str, transcript: str) -> str:
    """The client that needs no model: the transcript's first line is the summary, the title its topic."""
    import json

    first = (transcript or "").split("\n", 1)[0]
    return json.dumps({"summary": first, "topic_digests": [{"topic": title or "", "relevance": "primary", "digest": first, "speakers": []}]}, ensure_ascii=False)


def embeddings(df: DataFrame, client: Callable[[list[str]], list[list[float]]], text: str = "text", out: str = "embedding", batch: int = 100) -> DataFrame:
    """df with vectors that client gives for texts, a batch at a time, with retries."""

    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        got: list = []
        for i in range(0, len(s), batch):
            part = s.iloc[i : i + batch].fillna("").tolist()
            got += with_retry(lambda part=part: client(part))
        return pd.Series(got)

    return df.withColumn(out, embed(text))


def gram_vectors(df: DataFrame, key: str, text: str, size: int = 256, n: int = 3, out: str = "embedding") -> DataFrame:
    """key and a unit vector of each text without a model: runs of n characters, lower-cased, are counted in slots by hash.

    Texts alike in their wording lie near each other by cosine. Whole texts count; those shorter than n are one run, and null
    or empty ones have vectors of nothing but zeros. key tells rows apart. A row's vector is made in its task, some texts at
    a time, a long one in pieces; nothing is shuffled, and each distinct run of a task is hashed once.
    """
    small_batches(df.sparkSession)
    own = df.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("_low"))
    known: dict[str, int] = {}

    def slot(run: str) -> int:
        if run not in known:
            if len(known) > 1_000_000:
                known.clear()
            known[run] = int(hashlib.md5(run.encode(), usedforsecurity=False).hexdigest()[:8], 16) % size
        return known[run]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = np.zeros(len(texts) * size, np.int64)
            for joined, owner, at, runs in grams.runs(texts, n):
                _, first, which = np.unique(runs, return_index=True, return_inverse=True)
                slots = np.array([slot(joined[i : i + n]) for i in at[first].tolist()], np.int64)
                found, times = np.unique(owner * size + slots[which], return_counts=True) if len(at) else (np.zeros(0, np.int64),) * 2
                counts[found] += times
            for i, t in enumerate(texts):
                if 0 < len(t) < n:
                    counts[i * size + slot(t)] += 1
            counts = counts.reshape(-1, size)
            length = np.sqrt((counts * counts).sum(axis=1).astype(np.float64))
            values = np.divide(counts, length[:, None], out=np.zeros(counts.shape), where=length[:, None] > 0)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * size, pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=[key, out])

    return own.mapInArrow(run, StructType([own.schema[key], StructField(out, ArrayType(DoubleType()))]))


def result_summary(result: Column | str) -> Column:
    """A tool's JSON result in a few words: the number of rows, an error, a meeting, else its first 120 characters."""
    c = F.col(result) if isinstance(result, str) else result
    at = lambda path: F.get_json_object(c, path)
    rows, error, topics = at("$.rows"), at("$.error"), at("$.topicDigests")
    meeting = F.concat(F.lit("meeting="), F.coalesce(at("$.title"), F.lit("")), F.lit(" ("), F.coalesce(at("$.heldOn"), F.lit("")), F.lit(") topics="), F.coalesce(F.json_array_length(topics), F.lit(0)).cast("string"))
    return (
        F.when(rows.startswith("["), F.concat(F.lit("rows="), F.json_array_length(rows).cast("string")))
        .when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("error: "), error))
        .when(F.coalesce(at("$.meetingId"), F.lit("")) != "", meeting)
        .otherwise(F.substring(c, 1, 120))
    )


def progress(events: DataFrame, stream: str = "stream_id", order: str = "seq") -> DataFrame:
    """What a chat shows of a stream of events, one row a part, in place order: tool parts by (iteration, tool), where a later event replaces the part and moves it to the end, and texts, of which neighbours grow together.

    events: stream, order, type (tool_call, tool_result, final_delta; others say nothing), iteration, tool, said.
    """
    e = events.filter(F.col("type").isin("tool_call", "tool_result", "final_delta"))
    tools = e.filter("type <> 'final_delta'").groupBy(stream, F.concat_ws("-", F.lit("tool"), F.col("iteration").cast("string"), "tool").alias("part")).agg(F.max_by(F.struct(F.col(order).alias("at"), F.when(F.col("type") == "tool_call", "pending").otherwise("success").alias("status"), "said"), order).alias("l"))
    tools = tools.select(stream, "part", F.col("l.at").alias("at"), F.col("l.status").alias("status"), F.col("l.said").alias("said"))
    # texts grow together unless a tool's event, replaced later or not, came between them
    w = Window.partitionBy(stream).orderBy(order)
    texts = e.withColumn("_run", F.count_if(F.col("type") != "final_delta").over(w)).filter("type = 'final_delta'").groupBy(stream, "_run")
    texts = texts.agg(F.min(order).alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "said"))), lambda x: x["said"]), "").alias("said"))
    return tools.unionByName(texts.select(stream, F.lit("text").alias("part"), "at", F.lit(None).cast("string").alias("status"), "said"))
