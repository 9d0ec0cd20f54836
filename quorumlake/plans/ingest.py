"""Queries that go through landed files: folders of JSON lines with markers are written from the test tables, then read, checked and imported."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, runs
from ..operators.cuts import cut, made_once, new_folder
from ..sources import ndjson
from ..streaming import usage
from . import fixtures as fx
from . import oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


_LANDED: dict = {}
_FILES: set[tuple[str, str]] = set()


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Meetings to land: each in the folder of its year and of its municipality's nation. What their lines say is made from these columns when they lie in order."""
    o, c = fx.table(spark, d, "orders"), fx.table(spark, d, "customer")
    folder = [F.year("o_orderdate").cast("string").alias("year"), F.lpad(F.col("c_nationkey").cast("string"), 6, "0").alias("code")]
    return o.join(c, o.o_custkey == c.c_custkey).select(*folder, F.col("o_orderkey").alias("place"), "o_custkey", "o_orderdate", "o_orderpriority", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


def _said() -> tuple[Column, Column, Column, Column]:
    """Municipality, id, title and external id of a meeting, from the columns of _rows."""
    muni, month = F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.date_format("o_orderdate", "yyyy-MM")
    return muni, F.concat_ws("-", muni, month), F.concat(F.lit("Meeting of "), month), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))


def landed(spark: SparkSession, d: str, *names: str) -> str:
    """The folder with files of those names (none given: all) and all markers, each written once for the session and again when a table that they are made of has changed."""
    root = made_once(spark, _LANDED, "landed", [f"{d}/{name}.parquet" for name in ("orders", "customer", "lineitem")], lambda root: _mark(spark, d, root))
    for name in names or _LANDS:
        if (root, name) not in _FILES:
            _LANDS[name](spark, d, root)
            _FILES.add((root, name))
    return root


def _line(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))


def _land_meetings(spark: SparkSession, d: str, root: str) -> None:
    muni, id_, title, external = _said()
    held = F.when(F.col("price") <= 499900, F.date_format("o_orderdate", "yyyy-MM-dd"))
    ndjson.land(_rows(spark, d), root, ndjson.MEETINGS, _line(id=id_, municipalityCode=muni, title=title, meetingType=F.lower("o_orderpriority"), heldOn=held, externalId=external, status=F.col("status")))


def _land_statements(spark: SparkSession, d: str, root: str) -> None:
    li, m = fx.table(spark, d, "lineitem"), _rows(spark, d).select("year", "code", F.col("place").alias("meeting"), "o_custkey", "o_orderdate")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    said = li.join(m, li.l_orderkey == m.meeting).select("year", "code", F.struct(*keys).alias("place"), "l_quantity", "o_custkey", "o_orderdate")
    at = lambda name: F.col(f"place.{name}")
    ndjson.land(said, root, ndjson.STATEMENTS, _line(
        id=F.concat_ws("-", *[at(k).cast("string") for k in keys[:4]]), meetingId=F.when(at("l_extendedprice") > 99, _said()[1]),
        content=F.concat(F.lit("said of "), at("l_partkey").cast("string")), startOffset=F.when(F.col("l_quantity") < 25, at("l_linenumber") * 10).cast("int"),
    ))


def _land_summaries(spark: SparkSession, d: str, root: str) -> None:
    """Summaries of closed meetings, two of each urgent one."""
    _, _, title, external = _said()
    n = F.explode(F.when(F.lower("o_orderpriority") == "1-urgent", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    closed = _rows(spark, d).filter("status = 'F'").withColumn("n", n).withColumn("place", F.struct("place", "n")).drop("n")
    n, none = F.col("place.n").cast("string"), F.array().cast("array<struct<topic:string,relevance:string,digest:string,speakers:array<string>>>")
    digest = F.array(F.struct(F.lower(external).alias("topic"), F.lit("primary").alias("relevance"), title.alias("digest"), F.array(F.lit("S")).alias("speakers")))
    ndjson.land(closed, root, ndjson.SUMMARIES, _line(
        meetingId=F.lpad(F.col("place.place").cast("string"), 12, "0"), summary=F.when(F.col("price") <= 499900, F.concat(F.lit("summary "), n, F.lit(" of "), title)).otherwise(""),
        topicDigests=F.when(external.isNotNull(), digest).otherwise(none), summaryModel=F.concat(F.lit("model-"), n), summaryGeneratedAt=F.lit("2024-05-01T00:00:00"),
    ))


_LANDS = {ndjson.MEETINGS: _land_meetings, ndjson.STATEMENTS: _land_statements, ndjson.SUMMARIES: _land_summaries}


def _mark(spark: SparkSession, d: str, root: str) -> None:
    """Folders with more open than closed meetings were cut short: they have no marker. Those of code 000007 were imported before."""
    m, said = _rows(spark, d), fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("of")).agg(F.count("*").alias("k"))
    counts = [F.count("*").cast("int").alias("meetings"), (F.count_if(F.col("status") == "O") > F.count_if(F.col("status") == "F")).alias("truncated"), F.coalesce(F.sum("k"), F.lit(0)).cast("int").alias("statements")]
    folders = cut(m.join(said, m.place == said.of, "left").groupBy("year", "code").agg(*counts))
    ndjson.mark_complete(root, folders)
    ndjson.mark_imported(root, folders.filter("code = '000007' and not truncated"))
    ndjson.mark_summaries_imported(root, folders.filter("code = '000003'"))


_M = """m AS (SELECT year(o_orderdate)::varchar AS year, lpad(c_nationkey::varchar, 6, '0') AS code, o_orderkey AS place, lpad(o_custkey::varchar, 9, '0') AS muni,
  lpad(o_custkey::varchar, 9, '0') || '-' || strftime(o_orderdate, '%Y-%m') AS id, 'Meeting of ' || strftime(o_orderdate, '%Y-%m') AS title, lower(o_orderpriority) AS meeting_type,
  CASE WHEN o_totalprice <= 499900 THEN o_orderdate::date END AS held_on, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS external_id, o_orderstatus AS status, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT year, code, count(*) AS meetings, count(*) FILTER (status = 'O') > count(*) FILTER (status = 'F') AS truncated, count(*) FILTER (held_on IS NULL) = 0 AS ok FROM m GROUP BY 1, 2),
s AS (SELECT year, code, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_extendedprice > 99 THEN id END AS mid, CASE WHEN l_quantity < 25 THEN l_linenumber * 10 END AS start,
  row_number() OVER (PARTITION BY year, code ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_no FROM lineitem JOIN m ON l_orderkey = place)"""


@query(f"WITH {_M} SELECT year, code FROM f WHERE NOT truncated AND code <> '000007'")
def import_targets(spark, d):
    return ndjson.import_targets(spark, landed(spark, d, ndjson.MEETINGS))


@query(f"""WITH RECURSIVE {_M}, g AS (SELECT m.*, row_number() OVER (PARTITION BY muni ORDER BY m.year, m.code, place) AS k FROM m JOIN f ON m.year = f.year AND m.code = f.code WHERE NOT truncated AND ok AND m.code <> '000007'),
walk AS (SELECT muni, k, true AS stays, [id] AS ids, CASE WHEN external_id IS NULL THEN []::varchar[] ELSE [external_id] END AS exts FROM g WHERE k = 1 UNION ALL
  SELECT g.muni, g.k, NOT (list_contains(ids, g.id) OR coalesce(list_contains(exts, g.external_id), false)),
    CASE WHEN list_contains(ids, g.id) OR coalesce(list_contains(exts, g.external_id), false) THEN ids ELSE list_append(ids, g.id) END,
    CASE WHEN list_contains(ids, g.id) OR coalesce(list_contains(exts, g.external_id), false) OR g.external_id IS NULL THEN exts ELSE list_append(exts, g.external_id) END FROM walk w JOIN g ON g.muni = w.muni AND g.k = w.k + 1)
SELECT id, g.muni AS municipality_code, title, meeting_type, held_on, external_id FROM g JOIN walk w ON g.muni = w.muni AND g.k = w.k WHERE stays""")
def import_meetings(spark, d):
    return ndjson.import_meetings(spark, landed(spark, d, ndjson.MEETINGS))[0].select("id", "municipality_code", "title", "meeting_type", "held_on", "external_id")


@query(f"WITH {_M} SELECT year, code, ok FROM f WHERE NOT truncated AND code <> '000007'")
def import_outcome(spark, d):
    return ndjson.import_meetings(spark, landed(spark, d, ndjson.MEETINGS))[1]


@query(f"""WITH {_M}, z AS (SELECT year, code, place, 1 AS n, title, external_id, price FROM m WHERE status = 'F' UNION ALL SELECT year, code, place, 2, title, external_id, price FROM m WHERE status = 'F' AND meeting_type = '1-urgent'),
bad AS (SELECT DISTINCT year, code FROM z WHERE price > 499900), l AS (SELECT * FROM z WHERE (year, code) NOT IN (SELECT year, code FROM bad) AND code <> '000003' QUALIFY row_number() OVER (PARTITION BY place ORDER BY n DESC) = 1)
SELECT lpad(o_orderkey::varchar, 12, '0') AS id, CASE WHEN place IS NOT NULL THEN 'summary ' || n || ' of ' || title WHEN o_orderkey % 5 <> 0 THEN 'Summary ' || o_orderpriority END AS summary,
  CASE WHEN place IS NOT NULL THEN 'model-' || n END AS summary_model, CASE WHEN place IS NOT NULL THEN (external_id IS NOT NULL)::int END AS topics FROM orders LEFT JOIN l ON o_orderkey = place""")
def import_summaries(spark, d):
    none = F.lit(None)
    m = fx.meetings(spark, d).withColumns({"topic_digests": none.cast("array<struct<topic:string,relevance:string,digest:string,speakers:array<string>>>"), "summary_generated_at": none.cast("timestamp_ntz"), "summary_model": none.cast("string")})
    return ndjson.import_summaries(spark, landed(spark, d, ndjson.SUMMARIES), m)[0].select("id", "summary", "summary_model", F.size("topic_digests").alias("topics"))


@query(f"""WITH {_M}, b AS (SELECT year, code, min(line_no) AS n FROM s WHERE mid IS NULL GROUP BY 1, 2), x AS (SELECT year, code FROM s GROUP BY 1, 2),
q AS (SELECT year, code, count(*) AS n FROM m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.year = m.year AND s.code = m.code AND s.mid = m.id) GROUP BY 1, 2),
r AS (SELECT f.year, f.code, CASE WHEN truncated THEN 'no completion marker' WHEN x.year IS NULL THEN 'no statements file' WHEN b.n IS NOT NULL THEN 'statements line ' || b.n WHEN q.n > 0 THEN 'meetings without statements: ' || q.n END AS reason
  FROM f LEFT JOIN x ON f.year = x.year AND f.code = x.code LEFT JOIN b ON f.year = b.year AND f.code = b.code LEFT JOIN q ON f.year = q.year AND f.code = q.code)
SELECT year, code, reason IS NULL AS complete, reason FROM r""")
def integrity(spark, d):
    return ndjson.integrity(spark, landed(spark, d, ndjson.MEETINGS, ndjson.STATEMENTS))


@query(f"WITH {_M}, n AS (SELECT year, code, count(*) AS k FROM s GROUP BY 1, 2) SELECT f.year, f.code, f.code = '000007' AS imported, meetings::int AS meetings, coalesce(k, 0)::int AS statements FROM f LEFT JOIN n ON f.year = n.year AND f.code = n.code WHERE NOT truncated")
def markers(spark, d):
    return ndjson.markers(spark, landed(spark, d)).select("year", "code", "imported", "meetings", "statements")


@query(f"WITH {_M} SELECT DISTINCT year, code FROM m WHERE status = 'F' AND code <> '000003'")
def summary_targets(spark, d):
    return ndjson.summary_targets(spark, landed(spark, d, ndjson.SUMMARIES))


@query(f"WITH {_M} SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, mid AS meeting_id, (row_number() OVER (PARTITION BY mid ORDER BY start ASC NULLS LAST, year, code, line_no))::int AS place FROM s")
def statements_in_order(spark, d):
    rows = ndjson.read_statements(spark, landed(spark, d, ndjson.STATEMENTS)).withColumn("line_no", F.struct("year", "code", "line_no"))
    return runs.statement_order(rows, "meetingId", "startOffset").select("id", F.col("meetingId").alias("meeting_id"), "place")


@query(f"WITH {_M}, n AS (SELECT year, code, count(*) AS k FROM s GROUP BY 1, 2) SELECT sum(meetings)::bigint AS meetings, sum(coalesce(k, 0))::bigint AS statements, sum(CASE WHEN truncated THEN 1 ELSE 0 END)::bigint AS skipped, count(*) AS folders FROM f LEFT JOIN n ON f.year = n.year AND f.code = n.code")
def run_totals(spark, d):
    root = landed(spark, d, ndjson.MEETINGS, ndjson.STATEMENTS)
    count = lambda name, out: ndjson.lines(spark, root, name).groupBy("year", "code").agg(F.count("*").alias(out))
    done = ndjson.markers(spark, root).select("year", "code", F.lit(0).alias("no"))
    folders = count(ndjson.MEETINGS, "meetings").join(count(ndjson.STATEMENTS, "statements"), ["year", "code"], "left").join(done, ["year", "code"], "left")
    return runs.run_totals(folders.withColumn("skipped", F.when(F.col("no").isNull(), 1).otherwise(0)))


@query("""SELECT lpad(c_custkey::varchar, 9, '0') AS code, CASE WHEN c_mktsegment = 'BUILDING' THEN n_name ELSE c_name END AS name, n_name AS prefecture, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 'https://example.jp/' || c_custkey END AS base_url,
CASE WHEN floor(c_acctbal)::int <> 0 THEN floor(c_acctbal)::int END AS population, 2020 AS population_year FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def master_csv(spark, d):
    c, n = fx.table(spark, d, "customer"), fx.table(spark, d, "nation")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat_ws(
        ",", F.lpad(F.col("c_custkey").cast("string"), 9, "0"), quoted(F.col("n_name")), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(quoted(F.col("c_name"))), F.lit(""), F.lit("x"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.concat(F.lit("https://example.jp/"), F.col("c_custkey").cast("string"))).otherwise("-"), F.floor("c_acctbal").cast("string"), F.lit("2020"),
    ).alias("line"))
    path = new_folder(spark, "master")
    rows.write.text(path)  # parts of the list; each begins with no header, so that one goes before it
    parts = spark.read.text(path, wholetext=True).select(F.concat(F.lit("code,prefecture,name,a,b,url,population,year\n"), "value").alias("value"))
    parts.write.text(f"{path}-headed", lineSep="\n")
    return ndjson.read_master_csv(spark, f"{path}-headed").withColumn("base_url", F.when(F.col("base_url") != "-", F.col("base_url")))


@query("""WITH m AS (SELECT *, lpad(o_custkey::varchar, 9, '0') AS muni, o_orderdate::date::varchar AS day, 'Meeting ' || o_orderpriority AS title FROM orders)
SELECT sha256(muni || '|' || o_orderkey || '|' || day || '|' || title) AS id, left(day, 4)::int AS year, muni AS municipality, title, day AS held_on, n AS statements FROM m
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def written_scrape(spark, d):
    o, li = fx.table(spark, d, "orders"), fx.table(spark, d, "lineitem")
    said = li.repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("a"))
    nothing = F.lit(None).cast("string")
    statement = lambda x: F.struct(F.lit("remark").alias("kind"), nothing.alias("speaker_name"), nothing.alias("speaker_role"), F.concat(F.lit("said of "), x["l_partkey"].cast("string")).alias("content"), F.sha2(x["l_partkey"].cast("string"), 256).alias("content_hash"), x["l_linenumber"].cast("int").alias("start_offset"), x["l_linenumber"].cast("int").alias("end_offset"))
    m = o.join(said, o.o_orderkey == said.l_orderkey, "left").select(
        F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("municipality_code"), F.col("o_orderkey").cast("string").alias("external_id"), F.col("o_orderdate").cast("date").alias("held_on"), F.concat(F.lit("Meeting "), "o_orderpriority").alias("title"),
        F.lit("plenary").alias("meeting_type"), nothing.alias("source_url"), F.transform("a", statement).alias("statements"),
    )
    root = new_folder(spark, "scrape")
    ndjson.write_scrape(m.withColumn("municipality_code", F.col("municipality_code")), root, by="year")
    head = spark.read.schema("id string, municipalityCode string, title string, heldOn string, year int").json(f"{root}/meetings")
    count = spark.read.schema("meetingId string, year int").json(f"{root}/statements").groupBy("meetingId").agg(F.count("*").alias("statements"))
    return head.join(count, head.id == count.meetingId, "left").select("id", "year", F.col("municipalityCode").alias("municipality"), "title", F.col("heldOn").alias("held_on"), "statements")


@query("SELECT lpad(o_orderkey::varchar, 12, '0') AS meeting_id, year(o_orderdate)::int AS year, 'Summary ' || o_orderpriority AS summary FROM orders WHERE o_orderkey % 5 <> 0")
def appended_summaries(spark, d):
    m = fx.meetings(spark, d).filter("summary is not null")
    root = new_folder(spark, "summaries")
    rows = m.select(F.col("id").alias("meetingId"), F.substring("municipality_code", 1, 1).alias("municipalityCode"), F.col("held_on").cast("string").alias("heldOn"), "summary")
    ndjson.append_summaries(rows, root)
    return spark.read.schema("meetingId string, summary string, year int").json(f"{root}/summaries").select(F.col("meetingId").alias("meeting_id"), "year", "summary")


@query("""WITH old AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2), new AS (SELECT CASE WHEN p_size < 25 THEN p_brand ELSE 'Brand#new' END AS p_brand, p_name, p_size FROM part WHERE p_type LIKE '%BRASS' AND p_brand LIKE '%1'),
last AS (SELECT p_brand, p_name, 100 + count(*) AS n FROM new GROUP BY 1, 2) SELECT p_brand, p_name, n FROM last UNION ALL SELECT p_brand, p_name, n FROM old WHERE NOT EXISTS (SELECT 1 FROM last WHERE last.p_brand = old.p_brand AND last.p_name = old.p_name)""")
def upsert_written(spark, d):
    """An upsert into a table by brand: brands without a new row keep their files."""
    p, path = fx.table(spark, d, "part"), new_folder(spark, "topics")
    p.groupBy("p_brand", "p_name").agg(F.count("*").alias("n")).write.partitionBy("p_brand").parquet(path)
    new = p.filter(F.col("p_type").endswith("BRASS") & F.col("p_brand").endswith("1")).withColumn("p_brand", F.when(F.col("p_size") < 25, F.col("p_brand")).otherwise("Brand#new"))
    clean.upsert_into(spark, path, new.groupBy("p_brand", "p_name").agg((F.count("*") + 100).alias("n")), ["p_brand", "p_name"], "p_brand")
    return spark.read.parquet(path).select("p_brand", "p_name", "n")


@query("""SELECT lpad(o_orderkey::varchar, 12, '0') AS id, year(o_orderdate)::int AS year, CASE WHEN o_orderstatus = 'P' AND year(o_orderdate) = 1995 THEN 'committee of 1995' WHEN o_orderkey % 5 <> 0 THEN 'Summary ' || o_orderpriority END AS summary FROM orders""")
def update_written(spark, d):
    """A keyed update of a table by year: years without a change keep their files."""
    path = new_folder(spark, "updated")
    m = fx.meetings(spark, d).select("id", F.year("held_on").alias("year"), "summary", "meeting_type")
    m.select("id", "year", "summary").repartition("year").write.partitionBy("year").parquet(path)
    new = m.filter("meeting_type = 'committee' and year = 1995").select("id", F.lit("committee of 1995").alias("summary"))
    clean.update_into(spark, path, new, "id", ["summary"], "year")
    return spark.read.parquet(path).select("id", "year", "summary")


@query(f"WITH {_M} SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, year, line_no::int AS line_no FROM s WHERE year = '1995' AND code = '000004'")
def year_statements(spark, d):
    """Statements of one council and year, with their lines: no other folder is listed."""
    return ndjson.read_statements(spark, landed(spark, d, ndjson.STATEMENTS), [1995], ["000004"]).select("id", "year", "line_no")


# streams

def _events_stream(spark, d):
    """The events as a stream of files in no order of time, some files a trigger; a last event long after them lets all others be judged."""
    events = fx.table(spark, d, "events")
    path = new_folder(spark, "events")
    events.repartition(6, F.xxhash64("event_id")).write.parquet(path)
    closing = events.agg((F.max("ts") + F.make_dt_interval(F.lit(100))).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast("long").alias("user_id"))
    closing.withColumns({c: F.lit(None).cast(events.schema[c].dataType) for c in events.columns if c not in closing.columns}).select(*events.columns).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(path)


@query(f"SELECT event_id, user_id::varchar AS user_id FROM ({oracle.ORACLE['rate_admission'].replace('SELECT event_id, admitted, remaining::int AS remaining FROM walk', 'SELECT event_id, user_id, admitted FROM walk')}) WHERE admitted")
def usage_log(spark, d):
    """Calls through the limiter as a stream with keyed state, and the log of those admitted, which a sink appends to."""
    log, at = new_folder(spark, "usage"), new_folder(spark, "usage-at")
    usage.record_usage(usage.admission_stream(_events_stream(spark, d), "user_id", "ts", "event_id", 86400, 2, "60 days"), log, at)
    return spark.read.schema("event_id long, user_id string, ts timestamp").parquet(log).select("event_id", "user_id")


@query(f"WITH {_M} SELECT lpad(place::varchar, 12, '0') AS meeting_id, 'model-1' AS model FROM m WHERE status = 'F' UNION ALL SELECT lpad(place::varchar, 12, '0'), 'model-2' FROM m WHERE status = 'F' AND meeting_type = '1-urgent'")
def incremental_import(spark, d):
    """Landed summaries by a stream that brings each file once, however often it is asked; its first run delivers each batch twice, as after a failure."""
    out, at = new_folder(spark, "imported"), new_folder(spark, "imported-at")
    source = f"{landed(spark, d, ndjson.SUMMARIES)}/*/*/{ndjson.SUMMARIES}"
    sink = usage.once(out)

    def twice(df, number):
        sink(df, number)
        sink(df, number)

    for deliver in (twice, sink):
        usage.import_new_files(spark, source, "meetingId string, summaryModel string", at, deliver)
    return usage.committed(spark, out, "meetingId string, summaryModel string").select(F.col("meetingId").alias("meeting_id"), F.col("summaryModel").alias("model"))
