"""The queries that serve search: lists, topic search, timelines, co-occurrence, digests, audits.

Each takes DataFrames and parameters and returns a DataFrame. A parameter that is not given makes no predicate. Every
limited result has a total order.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_folded, left, like_pattern

#: Patterns of procedural items that should not be topics.
PROCEDURAL_PATTERNS = (
    "発言取消", "発言の取消", "発言取り消し", "陳情継続審査", "閉会中継続審査", "委員の選任", "委員の選挙", "委員会委員の選任",
    "会議録署名議員", "議長選挙", "副議長選挙", "会期決定", "会期の決定", "日程説明", "議案の委員会付託", "委員会付託",
)
#: White space of ECMAScript, at which search terms are split.
_BLANKS = "\t\n\x0b\x0c\r                  　﻿"


def all_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def search_tokens(text: str | None) -> list[str]:
    return [t for t in (text or "").translate({ord(c): " " for c in _BLANKS}).split(" ") if t]


def check_limit(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must lie between 1 and {most}")
    return limit


def meeting_filters(held_from=None, held_to=None, prefecture=None, municipality=None, codes=None, title=None) -> list[Column]:
    out: list[Column] = []
    if held_from:
        out.append(F.col("held_on") >= F.lit(held_from).cast("date"))
    if held_to:
        out.append(F.col("held_on") <= F.lit(held_to).cast("date"))
    if prefecture:
        out.append(F.col("prefecture") == prefecture)
    out += [F.col("name").like(like_pattern(t)) for t in search_tokens(municipality)]
    if codes:
        out.append(F.col("municipality_code").isin(*codes))
    if title:
        out.append(F.col("title").like(like_pattern(title)))
    return out


def list_meetings(meetings: DataFrame, municipalities: DataFrame, limit: int = 20, cursor=None, cursor_mode: str = "compat", **filters) -> DataFrame:
    """A page of meetings, newest first, with one row more than limit where there are more.

    cursor: in mode compat the last id of the page before, compared with ids alone, as the service this replaces does; in
    mode keyset the pair (held_on, id), which neither skips nor repeats rows.
    """
    check_limit(limit, 50)
    where = meeting_filters(**filters)
    if cursor is not None and cursor_mode == "compat":
        where.append(F.col("id") < F.lit(cursor))
    elif cursor is not None:
        day, last = cursor
        where.append((F.col("held_on") < F.lit(day).cast("date")) | ((F.col("held_on") == F.lit(day).cast("date")) & (F.col("id") < F.lit(last))))
    joined = meetings.join(municipalities, meetings.municipality_code == municipalities.code).filter(all_of(where))
    return joined.select("id", "title", "held_on", "prefecture", F.col("name").alias("municipality")).orderBy(F.desc("held_on"), F.desc("id")).limit(limit + 1)


def page_of(rows: list, limit: int) -> tuple[list, str | None]:
    """The page among at most limit + 1 collected rows, and the next cursor."""
    more = len(rows) > limit
    page = rows[:limit]
    return page, page[-1]["id"] if more else None


def municipality_filters(query: str | None = None, codes: Sequence[str] | None = None) -> list[Column]:
    out = [F.col("code").isin(*codes)] if codes else []
    for t in search_tokens(query):
        p = like_pattern(t)
        out.append(F.col("name").like(p) | F.col("prefecture").like(p) | F.coalesce(F.col("base_url").like(p), F.lit(False)))
    return out


def list_municipalities(municipalities: DataFrame, limit: int = 50, offset: int = 0, sort_by: str = "code", is_admin: bool = False, **filters) -> DataFrame:
    check_limit(limit, 100)
    order = [F.desc_nulls_last("population"), F.asc("code")] if sort_by == "population" else [F.asc("prefecture"), F.asc("code")]
    rows = municipalities.filter(all_of(municipality_filters(**filters))).orderBy(*order).offset(offset).limit(limit)
    return rows.select(
        F.col("code").alias("id"), "code", "name", "prefecture", F.when(F.lit(is_admin), F.col("base_url")).alias("base_url"), "population",
        F.lit(0).alias("meeting_count"), F.lit(None).cast("string").alias("system_type_description"),
    )


def count_municipalities(municipalities: DataFrame, **filters) -> DataFrame:
    return municipalities.filter(all_of(municipality_filters(**filters))).agg(F.count("*").alias("total"))


def _scope(code, date_from, date_to) -> list[Column]:
    out = [F.col("municipality_code") == code] if code else []
    return out + meeting_filters(date_from, date_to)


def search_topics(meetings: DataFrame, query: str, code=None, date_from=None, date_to=None, limit: int = 30) -> DataFrame:
    """(meeting, topic) pairs where topic, digest or the meeting's summary has the query, newest first; a summary gives all its topics."""
    check_limit(limit, 100)
    p = like_pattern(query)
    rows = meetings.filter(all_of([F.col("topic_digests").isNotNull(), *_scope(code, date_from, date_to)]))
    rows = rows.select(F.col("id").alias("meeting_id"), "title", "held_on", "meeting_type", "summary", F.posexplode("topic_digests").alias("pos", "d"))
    hit = F.coalesce(F.col("d.topic").ilike(p), F.lit(False)) | F.coalesce(F.col("d.digest").ilike(p), F.lit(False)) | F.coalesce(F.col("summary").ilike(p), F.lit(False))
    top = rows.filter(hit).orderBy(F.desc("held_on"), F.desc("meeting_id"), "pos").limit(limit)
    return top.select("meeting_id", "title", F.col("held_on").cast("string").alias("held_on"), "meeting_type", F.col("d.topic").alias("matched_topic"), F.col("d.relevance").alias("relevance"), left(F.col("d.digest"), 200).alias("digest_preview"))


def meeting_digest(meetings: DataFrame, meeting_id: str) -> DataFrame:
    one = meetings.filter(F.col("id") == meeting_id).limit(1)
    return one.select(F.col("id").alias("meeting_id"), "title", F.col("held_on").cast("string").alias("held_on"), "meeting_type", "source_url", "summary", F.coalesce("topic_digests", F.array().cast(meetings.schema["topic_digests"].dataType)).alias("topic_digests"))


def _has(keyword: str) -> Column:
    """Some digest's topic or text has the keyword, in any case: a predicate on the array, without a join."""
    p = like_pattern(keyword)
    return F.exists("topic_digests", lambda d: d["topic"].ilike(p) | d["digest"].ilike(p))


def _folded(d: Column, keyword: str) -> Column:
    return contains_folded(d["topic"], F.lit(keyword)) | contains_folded(d["digest"], F.lit(keyword))


def timeline_topic(meetings: DataFrame, municipalities: DataFrame, topic: str, code=None, date_from=None, date_to=None, limit: int = 100) -> DataFrame:
    """Meetings with a topic, oldest first, each with its matching topics."""
    check_limit(limit, 200)
    rows = meetings.filter(all_of([_has(topic), *_scope(code, date_from, date_to)])).join(municipalities, F.col("municipality_code") == municipalities.code)
    top = rows.orderBy("held_on", "id").limit(limit)
    return top.select(F.col("id").alias("meeting_id"), "title", F.col("held_on").cast("string").alias("held_on"), "meeting_type", "source_url", "municipality_code", F.col("name").alias("municipality_name"), "prefecture", F.filter("topic_digests", lambda d: _folded(d, topic)).alias("matched_topics"))


def meetings_with_topics(meetings: DataFrame, topics: Sequence[str], municipalities: DataFrame | None = None, code=None, limit: int = 20) -> DataFrame:
    """Meetings that have every keyword, newest first, with the names of matching topics by keyword. Without municipalities, their columns are left out."""
    check_limit(limit, 100)
    where = [_has(t) for t in topics] or [F.lit(False)]
    rows = meetings.filter(all_of(where + _scope(code, None, None)))
    names = ["municipality_code"]
    if municipalities is not None:
        rows = rows.join(municipalities, rows.municipality_code == municipalities.code).withColumn("municipality_name", F.col("name"))
        names += ["municipality_name", "prefecture"]
    top = rows.orderBy(F.desc("held_on"), F.desc("id")).limit(limit)
    def names_of(keyword: str) -> Column:
        return F.transform(F.filter("topic_digests", lambda d: _folded(d, keyword)), lambda d: d["topic"])

    matched = F.create_map(*[x for t in dict.fromkeys(topics) for x in (F.lit(t), names_of(t))]) if topics else F.create_map().cast("map<string,array<string>>")
    return top.select(F.col("id").alias("meeting_id"), "title", F.col("held_on").cast("string").alias("held_on"), "meeting_type", *names, matched.alias("matched_topics_by_query"))


def keyword_list(text: Column) -> Column:
    """Keywords of a comma-joined parameter: trimmed, none empty, the first of equal ones kept, five at most."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")), 1, 5)


def audit_totals(meetings: DataFrame, code=None) -> DataFrame:
    rows = meetings.filter(all_of([F.col("topic_digests").isNotNull(), *_scope(code, None, None)]))
    return rows.agg(F.count("*").alias("meetings"), F.coalesce(F.sum(F.size("topic_digests")), F.lit(0)).cast("long").alias("topics"))


def audit_patterns(meetings: DataFrame, patterns: Sequence[str] = PROCEDURAL_PATTERNS, code=None, limit: int = 50) -> DataFrame:
    """Digests that a procedural pattern hits, at most limit for each pattern, newest first; a digest may be hit by several.

    Patterns are a short list of literals: each digest makes a row for each pattern that it has, without a join.
    """
    rows = meetings.filter(all_of([F.col("topic_digests").isNotNull(), *_scope(code, None, None)]))
    rows = rows.select(F.col("id").alias("meeting_id"), "held_on", F.posexplode("topic_digests").alias("pos", "d"))
    folded = F.concat(F.lower("d.topic"), F.lit("\x00"), F.lower("d.digest"))
    hits = rows.withColumn("pattern", F.explode(F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(folded, F.lower(p)))))
    # a day's place follows from the counts of the days after it, so that only a pattern's hits of one day meet in a task
    after = Window.partitionBy("of").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = hits.groupBy(F.col("pattern").alias("of"), F.col("held_on").alias("day")).agg(F.count("*").alias("k"))
    days = days.withColumn("before", F.coalesce(F.sum("k").over(after), F.lit(0))).filter(F.col("before") < limit).drop("k")
    near = hits.join(F.broadcast(days), (F.col("pattern") == F.col("of")) & F.col("held_on").eqNullSafe(F.col("day")))
    w = Window.partitionBy("pattern", "held_on").orderBy(F.desc("meeting_id"), "pos")
    top = near.withColumn("n", (F.col("before") + F.row_number().over(w)).cast("int")).filter(F.col("n") <= limit)
    return top.select("pattern", "n", "meeting_id", F.col("held_on").cast("string").alias("held_on"), F.col("d.topic").alias("topic"), left(F.col("d.digest"), 160).alias("preview"))


def audit_report(hits: DataFrame) -> DataFrame:
    return hits.groupBy("pattern").agg(F.count("*").alias("hits"), F.countDistinct("meeting_id").alias("meetings"))
