"""Runs of a scraper and of a summariser: targets, totals, truncated lists, resets, logs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import adapter_key

#: Page families that many councils share; "custom" stands for all others.
SHARED_SYSTEMS = ("discussnet_ssp", "dbsearch", "kensakusystem", "gijiroku_com")
CUSTOM = "custom"


def scrape_targets(municipalities: DataFrame, adapters: DataFrame | None = None, codes: list[str] | None = None, system: str | None = None) -> DataFrame:
    """municipalities with a base_url, of the codes if given, whose page family has an adapter (adapters: a column key; none: every family has), of one system if given. adds system."""
    rows = municipalities.filter(F.col("base_url").isNotNull() & (F.col("base_url") != "")).withColumn("system", adapter_key("base_url", "code"))
    if codes is not None:
        rows = rows.filter(F.col("code").isin(*codes))
    if adapters is not None:
        rows = rows.join(adapters.select(F.col("key").alias("_key")).distinct(), F.col("system") == F.col("_key"), "left_semi")
    if system == CUSTOM:
        return rows.filter(~F.col("system").isin(*SHARED_SYSTEMS))
    return rows if system is None else rows.filter(F.col("system") == system)


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int | None) -> DataFrame:
    """The first k rows of each key, with truncated: whether there were more. No k: all rows."""
    if k is None:
        return df.withColumn("truncated", F.lit(False))
    w = Window.partitionBy(*keys).orderBy(*order)
    # k + 1 rows of a key at most go on, so that the count of them tells whether there are more
    few = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k + 1)
    return few.withColumn("truncated", F.count("*").over(Window.partitionBy(*keys)) > k).filter(F.col("_n") <= k).drop("_n")


def run_totals(folders: DataFrame) -> DataFrame:
    """meetings, statements, skipped and folders of a run: sums over its folders (meetings, statements, skipped), one row."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return folders.agg(total("meetings"), total("statements"), total("skipped"), F.count("*").alias("folders"))


def failures_by_system(attempts: DataFrame, url: str = "url", code: str | Column = "code") -> DataFrame:
    """Attempts and failures of each system: rows of attempts have an address, a code and failed."""
    rows = attempts.withColumn("system", adapter_key(url, code))
    return rows.groupBy("system").agg(F.count("*").alias("attempts"), F.count_if("failed").alias("failed"))


def counts_by_status(jobs: DataFrame, statuses: tuple = ("pending", "running", "completed", "failed")) -> DataFrame:
    """One row: total and a column for each status."""
    return jobs.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def latest_plenary(meetings: DataFrame, code: str) -> DataFrame:
    """The municipality's last plenary meeting; of several on a day that of the greatest id."""
    own = meetings.filter((F.col("municipality_code") == code) & (F.col("meeting_type") == "plenary"))
    return own.orderBy(F.desc("held_on"), F.desc("id")).limit(1)


def summary_queue(meetings: DataFrame, code: str, skip_existing: bool = True, limit: int | None = None) -> DataFrame:
    """Meetings of a municipality that are to be summarised, oldest first; those that have a summary are passed over."""
    own = meetings.filter(F.col("municipality_code") == code)
    own = own.filter(F.col("summary").isNull()) if skip_existing else own
    own = own.orderBy("held_on", "id").select("id", "title", "held_on", "municipality_code")
    return own if limit is None else own.limit(limit)


def statement_order(statements: DataFrame, meeting: str = "meeting_id", start: str = "start_offset", tie: str = "line_no") -> DataFrame:
    """place (from 1) of each statement of a meeting: by start, those without one last, ties in file order."""
    w = Window.partitionBy(meeting).orderBy(F.asc_nulls_last(start), tie)
    return statements.withColumn("place", F.row_number().over(w))


def reset_topics(topics: DataFrame, links: DataFrame, code: str) -> tuple[DataFrame, DataFrame]:
    """topics and links without those of a municipality: links go by a semi join with the topics that go."""
    gone = topics.filter(F.col("municipality_code") == code).select(F.col("id").alias("_gone"))
    return topics.filter(F.col("municipality_code") != code), links.join(gone, F.col("topic_id") == F.col("_gone"), "left_anti")


def vectors_in_order(replies: DataFrame) -> DataFrame:
    """Vectors of a batch reply (batch, items: array of index and embedding) in the order of the inputs."""
    return replies.select("batch", F.transform(F.array_sort("items"), lambda x: x["embedding"]).alias("vectors"))


def without(a: Column | str, b: Column | str) -> Column:
    """The entries of an array of byte strings that another lacks; all occurrences of the others stay, in order."""
    b = F.col(b) if isinstance(b, str) else b
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def run_log(runs: DataFrame, iterations: DataFrame) -> DataFrame:
    """run_id and markdown of each run.

    runs: run_id, started_at, preset, model, municipality_code, end_reason, error, question, input_tokens, output_tokens,
    api_calls, cost. iterations: run_id, index, call, kind (tool or final), name, args, result (JSON), text. A run has a few
    dozen iterations, so that its log is one value.
    """
    block = lambda c: F.concat(F.lit("```json\n"), F.coalesce(c, F.lit("null")), F.lit("\n```"))
    tool = F.concat_ws("\n\n", F.concat(F.lit("### "), "name"), F.lit("**Args**"), block(F.col("args")), F.lit("**Result**"), block(F.col("result")))
    first = F.col("call") == 0
    part = F.when(F.col("kind") == "final", F.concat_ws("\n\n", F.concat(F.lit("## Iteration "), F.col("index").cast("string"), F.lit(" — final answer")), F.col("text")))
    part = part.otherwise(F.concat(F.when(first, F.concat(F.lit("## Iteration "), F.col("index").cast("string"), F.lit(" — tool calls\n\n"))).otherwise(""), tool))
    steps = iterations.withColumn("part", part).groupBy(F.col("run_id").alias("_r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "call", "part"))), lambda x: x["part"]).alias("parts"))
    rows = runs.join(steps, F.col("run_id") == F.col("_r"), "left")
    item = lambda name, c: F.concat(F.lit(f"- **{name}**: "), c)
    head = F.concat_ws("\n", item("Preset", F.col("preset")), item("Model", F.col("model")), item("Municipality", F.coalesce("municipality_code", F.lit("(unspecified)"))), item("End reason", F.col("end_reason")), F.when(F.col("error").isNotNull() & (F.col("error") != ""), item("Error", F.col("error"))))
    cost = F.when(F.col("cost").isNotNull(), F.concat(F.lit("- Estimated cost: $"), F.format_string("%.6f", "cost"), F.lit(" ("), "model", F.lit(" pricing)"))).otherwise(F.concat(F.lit("- Estimated cost: n/a (unknown pricing for "), "model", F.lit(")")))
    usage = F.concat_ws("\n", *[F.concat(F.lit(f"- {n}: "), F.col(c).cast("string")) for n, c in (("Input tokens", "input_tokens"), ("Output tokens", "output_tokens"), ("API calls", "api_calls"))], cost)
    title = F.concat(F.lit("# Agent Run — "), F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    body = F.concat_ws("\n\n", title, head, F.lit("## Question"), "question", F.array_join(F.coalesce("parts", F.array().cast("array<string>")), "\n\n"), F.lit("## Usage"), usage)
    return rows.select("run_id", F.concat(body, F.lit("\n")).alias("markdown"))
