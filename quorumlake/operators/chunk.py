"""Utterances: offsets, speaker runs, chunks of bounded size, transcripts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import is_noise
from .cuts import cut

MAX_CHUNK = 1500


def offsets(df: DataFrame, group: str, order: list[str], content: str = "content", length: Column | None = None) -> DataFrame:
    """start_offset and end_offset of each utterance in its meeting's text, one character between neighbours."""
    n = F.length(content) if length is None else length
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(n + 1).over(before), F.lit(0)).cast("long")
    return df.withColumn("start_offset", start).withColumn("end_offset", (F.col("start_offset") + n).cast("long"))


def speaker_runs(df: DataFrame, group: str, order: list[str], speaker: str = "speaker_name") -> DataFrame:
    """run: number from 0 of the stretch of neighbouring rows with one speaker; null speakers equal each other."""
    w = Window.partitionBy(group).orderBy(*order)
    changed = (~F.lag(speaker).over(w).eqNullSafe(F.col(speaker)) & (F.row_number().over(w) > 1)).cast("int")
    return df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w).cast("long")).drop("_c")


def chunk_starts(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys and idx of the rows that begin a chunk: the first of a run, then always the first that the open chunk has no room for.

    rows: keys, idx (from 0 in a run), before and upto (sums of lengths without and with the row). A row's successor is the
    number of rows that still fit with it, found for all rows by one sort of sums and limits; it lies behind the row at least.
    Pointer doubling then follows the successors: after a round the first 2, 4, 8 … starts of every run are known, so that
    rounds grow with the logarithm of a run's number of chunks, and no run is held anywhere as a whole.
    """
    sums = rows.select(*keys, "idx", F.col("upto").alias("at"), F.lit(0).alias("asks"))
    asked = rows.select(*keys, "idx", (F.col("before") + most).alias("at"), F.lit(1).alias("asks"))
    so_far = Window.partitionBy(*keys).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.sum(1 - F.col("asks")).over(so_far)
    size = F.count_if(F.col("asks") == 0).over(Window.partitionBy(*keys))
    found = sums.unionByName(asked).withColumn("fits", fits).withColumn("size", size).filter("asks = 1")
    jump = cut(found.select(*keys, "idx", F.greatest("fits", F.col("idx") + 1).alias("next"), "size").filter("next < size").drop("size"))
    longest = rows.agg(F.max("upto")).first()[0] or 0
    chunks = 2 * longest // most + 2  # two chunks in a row hold more than most
    starts = rows.filter("idx = 0").select(*keys, "idx")
    for _ in range(chunks.bit_length()):
        starts = cut(starts.unionByName(starts.join(jump, [*keys, "idx"]).select(*keys, F.col("next").alias("idx"))))
        after = jump.select(*keys, F.col("idx").alias("next"), F.col("next").alias("then"))
        jump = cut(jump.join(after, [*keys, "next"]).select(*keys, "idx", F.col("then").alias("next")))
    return starts


def chunk_statements(df: DataFrame, group: str = "meeting_id", order: list[str] | None = None, most: int = MAX_CHUNK, length: Column | None = None, drop_noise: bool = True) -> DataFrame:
    """Chunks of substantive utterances: runs of one speaker after noise is gone, cut greedily; the newlines that join contents do not count.

    Columns: group, run, chunk_index, speaker_name, speaker_role, statement_ids, content. Rows equal in order go by id,
    speaker and content. Only runs that are longer than a chunk are searched for its starts; a row's lists are those of a chunk.
    """
    order = [*(order or ["position"]), "id", "speaker_name", "speaker_role", "content"]
    if drop_noise:
        df = df.filter(~is_noise("content"))
    df = speaker_runs(df.withColumn("_len", (F.length("content") if length is None else length).cast("long")), group, order)
    in_run = Window.partitionBy(group, "run").orderBy(*order)
    rows = df.withColumn("idx", F.row_number().over(in_run) - 1).withColumn("upto", F.sum("_len").over(in_run.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("upto") - F.col("_len")).withColumn("total", F.sum("_len").over(Window.partitionBy(group, "run")))
    rows = rows.withColumn("_g", F.struct(group))  # equal where the group is null too
    long = cut(rows.filter(F.col("total") > most).select("_g", "run", "idx", "before", "upto"))
    named = rows.select(group, "_g", "run", "idx", "total", "id", "speaker_name", "speaker_role", "content")
    if long.isEmpty():
        numbered = named.withColumn("chunk_index", F.lit(0))
    else:
        starts = chunk_starts(long, ["_g", "run"], most).withColumn("starts", F.lit(1))
        marked = named.join(starts, ["_g", "run", "idx"], "left")
        so_far = Window.partitionBy(group, "run").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
        numbered = marked.withColumn("chunk_index", F.when(F.col("total") > most, F.sum(F.coalesce("starts", F.lit(0))).over(so_far) - 1).otherwise(0).cast("int"))
    item = F.struct("idx", "id", "speaker_name", "speaker_role", "content")
    chunks = numbered.groupBy(group, "run", "chunk_index").agg(F.array_sort(F.collect_list(item)).alias("mine"))
    return chunks.select(
        group, "run", "chunk_index", F.col("mine")[0]["speaker_name"].alias("speaker_name"), F.col("mine")[0]["speaker_role"].alias("speaker_role"),
        F.transform("mine", lambda x: x["id"]).alias("statement_ids"), F.array_join(F.transform("mine", lambda x: x["content"]), "\n").alias("content"),
    )


def transcript(df: DataFrame, group: str, order: list[str], unknown: str = "不明") -> DataFrame:
    """One text a meeting: '[kind] name/role: content' a line."""
    who = F.concat_ws("/", F.nullif(F.col("speaker_name"), F.lit("")), F.nullif(F.col("speaker_role"), F.lit("")))
    line = F.concat(F.lit("["), F.col("kind"), F.lit("] "), F.when(who == "", unknown).otherwise(who), F.lit(": "), F.col("content"))
    rows = df.select(group, F.struct(*order, line.alias("line")).alias("r"))
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "\n").alias("transcript"))


def carry_speaker(df: DataFrame, group: str, order: list[str], header: Column) -> DataFrame:
    """Lines with the header that they stand under (header: null for other lines) and its block number; lines before the first header go."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    lines = df.withColumn("header", header)
    lines = lines.withColumn("block", F.sum(F.col("header").isNotNull().cast("int")).over(w).cast("long")).withColumn("under", F.last("header", ignorenulls=True).over(w))
    return lines.filter("block > 0")


def group_first_seen(df: DataFrame, keys: list[str], position: str, item: Column) -> DataFrame:
    """Groups with their items in order of position, and first: the position at which the group is first seen."""
    rows = df.groupBy(*keys).agg(F.min(position).alias("first"), F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), item.alias("item")))).alias("_i"))
    return rows.withColumn("items", F.transform("_i", lambda x: x["item"])).drop("_i")
