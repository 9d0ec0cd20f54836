"""Newline-delimited JSON in {root}/{year}/{code}/ folders: discovery, markers, readers, writers, integrity.

Files are read in byte ranges, as Spark's text reader splits them, whatever their size. Line numbers follow from prefix sums
of the ranges' lines. Only the folders of the years and councils that are asked for are listed.
"""

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators import clean
from ..operators.cuts import cut

MEETINGS, STATEMENTS, SUMMARIES = "meetings.ndjson", "statements.ndjson", "summaries.ndjson"
COMPLETE, SUMMARIES_COMPLETE = "_complete", "_summaries_complete"
_PLACE = "/(\\d{4})/([^/]+)/[^/]+$"


def _files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """path, year, code and content of every file of that name. Underscored names are read too."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    return raw.select("path", F.regexp_extract("path", _PLACE, 1).alias("year"), F.regexp_extract("path", _PLACE, 2).alias("code"), F.col("content").cast("string").alias("body")).filter("year <> ''")


#: Ranges of files whose numbers of lines are sent to all tasks, at most; beyond that they are joined by a shuffle.
BROADCAST_RANGES = 200_000


def _glob(root: str, name: str, years: list | None, codes: list[str] | None) -> str:
    some = lambda given, every: every if not given else f"{{{','.join(map(str, given))}}}" if len(given) > 1 else str(given[0])
    return f"{root}/{some(years, '[0-9][0-9][0-9][0-9]')}/{some(codes, '*')}/{name}"


def lines(spark: SparkSession, root: str, name: str, years: list | None = None, codes: list[str] | None = None) -> DataFrame:
    """path, year, code, line_no (from 1) and line of the files of that name, of some years and codes if given; blank lines included, but for what follows the last line end.

    A range's lines are consecutive in its task. How many there are, and with which number the first one stands in the task,
    is found by a first pass that returns a row for each range; the lines themselves are not shuffled.
    """
    path = _glob(root, name, years, codes)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not (at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []):
        return spark.createDataFrame([], "path string, year string, code string, line_no int, line string")
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"), "value")
    ranges = raw.groupBy(F.col("path").alias("of"), F.col("range").alias("of_range")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("of").orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = cut(ranges.withColumn("before", before))
    told = F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges
    rows = raw.join(told, (F.col("path") == F.col("of")) & (F.col("range") == F.col("of_range")))
    number = (F.col("at") - F.col("first") + F.col("before") + 1).cast("int")
    return rows.select("path", F.regexp_extract("path", _PLACE, 1).alias("year"), F.regexp_extract("path", _PLACE, 2).alias("code"), number.alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))


def _parsed(rows: DataFrame, schema) -> DataFrame:
    keep = ["path", "year", "code", "line_no", "line"]
    return rows.withColumn("r", F.from_json("line", schema)).select(*keep, "r.*")


def read_meetings(spark: SparkSession, root: str) -> DataFrame:
    """Meeting rows; a blank or broken line is a row with null fields, so that validation sees it."""
    return _parsed(lines(spark, root, MEETINGS), schemas.MEETING_LINE)


def read_statements(spark: SparkSession, root: str, years: list | None = None, codes: list[str] | None = None) -> DataFrame:
    return _parsed(lines(spark, root, STATEMENTS, years, codes).filter(F.trim("line") != ""), schemas.STATEMENT_LINE)


def read_summaries(spark: SparkSession, root: str) -> DataFrame:
    return _parsed(lines(spark, root, SUMMARIES).filter(F.trim("line") != ""), schemas.SUMMARY_LINE)


def _listed(spark: SparkSession, root: str, name: str) -> list[tuple[str, str, object]]:
    """year, code and file status of every file of that name, by the file system that holds root; Spark's readers pass over empty and underscored files."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(base, f"[12][0-9][0-9][0-9]/*/{name}")) or []
    return [(*status.getPath().toString().split("/")[-3:-1], status) for status in found]


def present(spark: SparkSession, root: str, name: str) -> DataFrame:
    """year and code of the folders that have such a file, if only an empty one."""
    return spark.createDataFrame([(y, c) for y, c, _ in _listed(spark, root, name)], "year string, code string")


def markers(spark: SparkSession, root: str, name: str = COMPLETE) -> DataFrame:
    """year, code and the marker's fields; imported is false where the marker is malformed or says nothing.

    Markers are a line each, one for a folder; Spark's readers pass over underscored names, so that the driver opens them,
    many at a time.
    """
    listed = _listed(spark, root, name)
    with ThreadPoolExecutor(16) as pool:
        bodies = list(pool.map(lambda x: _read(spark, x[2].getPath()), listed))
    df = spark.createDataFrame([(y, c, body) for (y, c, _), body in zip(listed, bodies, strict=True)], "year string, code string, body string")
    said = F.col("m.summariesImported") if name == SUMMARIES_COMPLETE else F.col("m.imported")
    return df.withColumn("m", F.from_json("body", schemas.MARKER)).select("year", "code", F.coalesce(said, F.lit(False)).alias("imported"), "m.completedAt", "m.meetings", "m.statements")


def _read(spark: SparkSession, path) -> str:
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, body: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(body.encode()))
    finally:
        stream.close()


def _write_all(spark: SparkSession, files: list[tuple[str, str]]) -> None:
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda x: _write(spark, *x), files))


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def mark_complete(root: str, folders: DataFrame) -> None:
    """Writes the completion marker of each folder (year, code, meetings, statements, truncated) that was not truncated."""
    done = folders.filter("not truncated").select("year", "code", "meetings", "statements").collect()  # a row for a folder
    _write_all(folders.sparkSession, [(f"{root}/{r.year}/{r.code}/{COMPLETE}", json.dumps({"completedAt": _now(), "meetings": r.meetings, "statements": r.statements}) + "\n") for r in done])


def mark_imported(root: str, folders: DataFrame) -> None:
    """Adds imported and importedAt to the markers of folders (year, code); other fields stay."""
    spark = folders.sparkSession
    held = {(y, c): status for y, c, status in _listed(spark, root, COMPLETE)}
    out = []
    for r in folders.select("year", "code").collect():
        body = json.loads(_read(spark, held[r.year, r.code].getPath()))
        out.append((f"{root}/{r.year}/{r.code}/{COMPLETE}", json.dumps(body | {"imported": True, "importedAt": _now()}) + "\n"))
    _write_all(spark, out)


def mark_summaries_imported(root: str, folders: DataFrame) -> None:
    _write_all(folders.sparkSession, [(f"{root}/{r.year}/{r.code}/{SUMMARIES_COMPLETE}", json.dumps({"summariesImported": True, "importedAt": _now()}) + "\n") for r in folders.select("year", "code").collect()])


def land(rows: DataFrame, root: str, name: str, line: Column | None = None) -> None:
    """Writes the lines of rows (year, code, place and what line is made of; none: a column line) as {root}/{year}/{code}/{name}, in order of place, one file a folder.

    Spark writes a part for each folder; the parts then get their names, which moves no data. Lines are made after the sort,
    so that their texts are neither shuffled nor sorted. Folders are told by bytes: where a write is partitioned by strings,
    Spark replaces the sort by one of its own, of whole lines and by folder alone; so it does where a folder is a constant,
    to which nothing of the place is therefore added.
    """
    spark, staged = rows.sparkSession, f"{root}/_staged-{uuid.uuid4().hex}"
    nothing = F.substring(F.xxhash64("place").cast("string"), 1, 0)
    folders = {c: F.concat(F.col(c), nothing).cast("binary") for c in ("year", "code")}
    dealt = rows.withColumns(folders).repartition("year", "code").sortWithinPartitions("year", "code", "place")
    dealt.select("year", "code", (F.col("line") if line is None else line).alias("line")).write.partitionBy("year", "code").text(staged)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def move(status) -> None:
        year, code = (x.split("=", 1)[1] for x in status.getPath().toString().split("/")[-3:-1])
        fs.mkdirs(path(f"{root}/{year}/{code}"))
        fs.rename(status.getPath(), path(f"{root}/{year}/{code}/{name}"))

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(move, fs.globStatus(path(f"{staged}/year=*/code=*/part-*")) or []))
    fs.delete(path(staged), True)


def import_targets(spark: SparkSession, root: str, codes: list[str] | None = None, skip_imported: bool = True) -> DataFrame:
    """year and code of folders that are complete and have meetings; no codes: all."""
    done = markers(spark, root)
    rows = _files(spark, root, MEETINGS).select("year", "code").distinct().join(done, ["year", "code"])
    rows = rows.filter(F.col("code").isin(*codes)) if codes else rows
    return (rows.filter("not imported") if skip_imported else rows).select("year", "code")


def summary_targets(spark: SparkSession, root: str, codes: list[str] | None = None, skip_imported: bool = True) -> DataFrame:
    """The same for summaries, which need no completion marker and have a marker of their own."""
    done = markers(spark, root, SUMMARIES_COMPLETE)
    rows = _files(spark, root, SUMMARIES).select("year", "code").distinct().join(done, ["year", "code"], "left")
    rows = rows.filter(F.col("code").isin(*codes)) if codes else rows
    return (rows.filter(~F.coalesce("imported", F.lit(False))) if skip_imported else rows).select("year", "code")


def import_meetings(spark: SparkSession, root: str, target: DataFrame | None = None, codes: list[str] | None = None, skip_imported: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows that an import of complete folders adds to target, and (year, code, ok) of each folder.

    A folder with a line that does not parse, or without heldOn, fails as a whole. Rows go in by folder and line; one whose
    id, or municipality and external id, is taken is left out.
    """
    targets = import_targets(spark, root, codes, skip_imported)
    # folders are numbered in their order, a row for each: a line's place is one number, in place of its folder's names
    folders = cut(targets.withColumn("folder", F.row_number().over(Window.orderBy("year", "code"))))
    rows = read_meetings(spark, root).join(F.broadcast(folders), ["year", "code"])
    good = clean.passing_groups(rows, "folder", clean.meeting_line_valid())
    place = F.col("folder").cast("long") * (1 << 32) + F.col("line_no")
    named = good.select(place.alias("place"), "id", F.col("municipalityCode").alias("municipality_code"), "title", F.col("meetingType").alias("meeting_type"), F.col("heldOn").cast("date").alias("held_on"), F.col("sourceUrl").alias("source_url"), F.col("externalId").alias("external_id"))
    added = clean.insert_ignore(named, target, [["id"], ["municipality_code", "external_id"]], [F.col("place")]).drop("place")
    verdict = rows.groupBy("year", "code").agg(F.bool_and(F.coalesce(clean.meeting_line_valid(), F.lit(False))).alias("ok"))
    return added, verdict


def import_summaries(spark: SparkSession, root: str, meetings: DataFrame, codes: list[str] | None = None, skip_imported: bool = True) -> tuple[DataFrame, DataFrame]:
    """meetings with summary, topic_digests, summary_generated_at and summary_model from the folders' summaries, and (year, code, ok).

    Of several lines for a meeting in a folder the last one holds, and of several folders the last; a folder with an invalid line fails as a whole.
    """
    targets = summary_targets(spark, root, codes, skip_imported)
    rows = read_summaries(spark, root).join(targets, ["year", "code"], "left_semi").withColumn("dir", F.concat_ws("/", "year", "code"))
    parsed = rows.filter(F.from_json("line", "struct<meetingId:string>").isNotNull())
    good = clean.passing_groups(parsed, "dir", clean.summary_line_valid())
    last = clean.last_wins(good.select("meetingId", F.struct("dir", "line_no").alias("place"), "summary", F.col("topicDigests").alias("topic_digests"), F.col("summaryGeneratedAt").cast("timestamp_ntz").alias("summary_generated_at"), F.col("summaryModel").alias("summary_model")), ["meetingId"], "place")
    columns = ["summary", "topic_digests", "summary_generated_at", "summary_model"]
    updated = clean.keyed_update(meetings, last.withColumnRenamed("meetingId", "id"), "id", columns)
    return updated, parsed.groupBy("year", "code").agg(F.bool_and(F.coalesce(clean.summary_line_valid(), F.lit(False))).alias("ok"))


def statements_of(spark: SparkSession, root: str, meeting_id: str, year: int) -> DataFrame:
    """A meeting's statements from the year it was held in, else from the first other year's folder that has any; by offset, null offsets last.

    The year's folders alone are listed and read, unless they hold none of the meeting's.
    """
    own = read_statements(spark, root, [year]).filter(F.col("meetingId") == meeting_id)
    others = sorted({y for y, _, _ in _listed(spark, root, STATEMENTS)} - {str(year)}) if own.isEmpty() else []
    for other in others:
        found = read_statements(spark, root, [other]).filter(F.col("meetingId") == meeting_id)
        if not found.isEmpty():
            own = found
            break
    first = own.agg(F.min("path").alias("first"))  # one row
    return own.join(F.broadcast(first), F.col("path") == F.col("first")).drop("first").orderBy(F.asc_nulls_last("startOffset"), "line_no")


def integrity(spark: SparkSession, root: str) -> DataFrame:
    """complete and the first failing reason of each folder that has any of the files or a marker."""
    m = lines(spark, root, MEETINGS).filter(F.trim("line") != "").withColumn("r", F.from_json("line", "id string"))
    s = lines(spark, root, STATEMENTS).filter(F.trim("line") != "").withColumn("r", F.from_json("line", "meetingId string"))
    key = ["year", "code"]
    bad = lambda field: F.min(F.when(F.coalesce(F.col(f"r.{field}"), F.lit("")) == "", F.col("line_no")))
    has_m = present(spark, root, MEETINGS).withColumn("has_m", F.lit(True))
    has_s = present(spark, root, STATEMENTS).withColumn("has_s", F.lit(True))
    done = markers(spark, root).select(*key).distinct().withColumn("done", F.lit(True))
    ids = m.select(*key, F.col("r.id").alias("id")).filter("id <> ''")
    said = s.select(*key, F.col("r.meetingId").alias("id")).filter("id <> ''").distinct()
    silent = ids.join(said, [*key, "id"], "left_anti").groupBy(*key).agg(F.count("*").alias("silent"))
    m_stats = m.groupBy(*key).agg(bad("id").alias("m_bad"), F.count("*").alias("m_rows"))
    s_stats = s.groupBy(*key).agg(bad("meetingId").alias("s_bad"))
    rows = has_m.join(has_s, key, "full").join(done, key, "full").join(m_stats, key, "left").join(s_stats, key, "left").join(silent, key, "left")
    reason = (
        F.when(F.col("done").isNull(), "no completion marker")
        .when(F.col("has_m").isNull(), "no meetings file")
        .when(F.col("has_s").isNull(), "no statements file")
        .when(F.col("m_bad").isNotNull(), F.concat(F.lit("meetings line "), F.col("m_bad").cast("string")))
        .when(F.coalesce("m_rows", F.lit(0)) == 0, "no meetings")
        .when(F.col("s_bad").isNotNull(), F.concat(F.lit("statements line "), F.col("s_bad").cast("string")))
        .when(F.col("silent") > 0, F.concat(F.lit("meetings without statements: "), F.col("silent").cast("string")))
    )
    return rows.select(*key, reason.isNull().alias("complete"), reason.alias("reason"))


def write_scrape(meetings: DataFrame, root: str, by: str = "code") -> None:
    """Meetings (with an array of statements) as two sets of JSON lines under year=/code= folders (by "year": year= ones alone, for very many councils); ids follow from natural keys, so that a rerun writes the same. The files are compressed, as most of a line is hashes and names."""
    key = F.concat_ws("|", "municipality_code", "external_id", "held_on", "title")
    m = meetings.withColumn("id", F.sha2(key, 256)).withColumn("year", F.substring(F.col("held_on").cast("string"), 1, 4)).withColumn("code", F.col("municipality_code"))
    head = m.select("year", "code", "id", F.col("municipality_code").alias("municipalityCode"), "title", F.col("meeting_type").alias("meetingType"), F.col("held_on").cast("string").alias("heldOn"), F.col("source_url").alias("sourceUrl"), F.col("external_id").alias("externalId"), F.lit("processed").alias("status"))
    said = m.select("year", "code", F.col("id").alias("meetingId"), F.posexplode("statements").alias("pos", "s"))
    said = said.select("year", "code", F.sha2(F.concat_ws("|", "meetingId", F.col("pos").cast("string")), 256).alias("id"), "meetingId", "s.kind", F.col("s.speaker_name").alias("speakerName"), F.col("s.speaker_role").alias("speakerRole"), "s.content", F.col("s.content_hash").alias("contentHash"), F.col("s.start_offset").alias("startOffset"), F.col("s.end_offset").alias("endOffset"))
    folders = ["year", "code"] if by == "code" else ["year"]
    for rows, name in ((head, "meetings"), (said, "statements")):
        (rows if by == "code" else rows.drop("code")).write.mode("append").partitionBy(*folders).json(f"{root}/{name}", compression="gzip")


def append_summaries(summaries: DataFrame, root: str) -> None:
    """Summary rows as JSON lines under year= folders; a row without a four-digit year fails the write."""
    year = F.regexp_extract("heldOn", "^(\\d{4})-", 1)
    checked = F.when(year == "", F.raise_error(F.concat(F.lit("no year in heldOn: "), F.coalesce("heldOn", F.lit("null"))))).otherwise(year)
    summaries.withColumn("year", checked).withColumn("code", F.col("municipalityCode")).write.mode("append").partitionBy("year", "code").json(f"{root}/summaries")


def read_master_csv(spark: SparkSession, path: str) -> DataFrame:
    """The master list: no quoted commas; quotes stripped; columns 0, 1, 2, 5, 6 and 7; a missing name is the prefecture; 0 and no number are null."""
    f = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\r?\\n")).alias("pos", "line")).filter("pos > 0 and trim(line) <> ''")
    c = F.transform(F.split("line", ","), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    at = lambda i: F.get(F.col("c"), F.lit(i))
    number = lambda i: F.nullif(F.regexp_extract(F.coalesce(at(i), F.lit("")), "^\\s*(-?\\d+)", 1).try_cast("int"), F.lit(0))
    rows = f.withColumn("c", c)
    return rows.select(at(0).alias("code"), F.coalesce(F.nullif(at(2), F.lit("")), at(1)).alias("name"), at(1).alias("prefecture"), at(5).alias("base_url"), number(6).alias("population"), number(7).alias("population_year"))
