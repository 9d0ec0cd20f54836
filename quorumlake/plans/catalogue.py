"""Registered queries: each operator over its whole tables. Their SQL twins are in oracle.py under the same names."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, dates, speakers, text
from ..operators import chunk, clean, grams, limits, runs, topics
from . import fixtures as fx
from . import search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# lists

@query
def list_meetings(spark, d):
    return search.list_meetings(fx.meetings(spark, d), fx.municipalities(spark, d), limit=20)


@query
def list_meetings_filtered(spark, d):
    return search.list_meetings(fx.meetings(spark, d), fx.municipalities(spark, d), limit=50, held_from="1997-01-01", held_to="1997-06-30", prefecture="NATION_3", title="HIGH")


@query
def list_meetings_tokens(spark, d):
    return search.list_meetings(fx.meetings(spark, d), fx.municipalities(spark, d), limit=30, municipality=" Customer　00 7 ")


@query
def list_meetings_codes(spark, d):
    return search.list_meetings(fx.meetings(spark, d), fx.municipalities(spark, d), limit=40, codes=["000000007", "000000011", "000000013"])


@query
def list_meetings_cursor_compat(spark, d):
    return search.list_meetings(fx.meetings(spark, d), fx.municipalities(spark, d), limit=20, cursor="000000000700")


@query
def list_meetings_cursor_keyset(spark, d):
    return search.list_meetings(fx.meetings(spark, d), fx.municipalities(spark, d), limit=20, cursor=("1999-06-01", "000000000700"), cursor_mode="keyset")


@query
def list_municipalities_code(spark, d):
    return search.list_municipalities(fx.municipalities(spark, d), limit=50, offset=10)


@query
def list_municipalities_population(spark, d):
    return search.list_municipalities(fx.municipalities(spark, d), limit=60, offset=20, sort_by="population", is_admin=True)


@query
def list_municipalities_tokens(spark, d):
    return search.list_municipalities(fx.municipalities(spark, d), limit=100, query="NATION_1 machinery", is_admin=True)


@query
def list_municipalities_total(spark, d):
    return search.count_municipalities(fx.municipalities(spark, d), query="NATION_1 machinery")


# topics

@query
def search_topics(spark, d):
    return search.search_topics(fx.with_digests(spark, d), "gear", date_from="1996-01-01", limit=30)


@query
def search_topics_summary_only(spark, d):
    return search.search_topics(fx.with_digests(spark, d), "summary 2-high", code=None, date_to="1998-12-31", limit=100)


@query
def search_topics_wildcard(spark, d):
    return search.search_topics(fx.with_digests(spark, d), "s_all%bolt", limit=50)


@query
def search_topics_indexed(spark, d):
    """search_topics on the blocks that the postings leave."""
    pattern = text.like_pattern("Large Gear")
    return search.search_topics(grams.pruned(spark, fx.indexed_digests(spark, d), pattern), "Large Gear", date_from="1996-01-01", limit=30)


@query
def documents_with(spark, d):
    """Documents with a passage, in any case, read from the blocks that have all its runs of three characters."""
    found = []
    for words in ("general public license", "permission is hereby granted", "c", "l%cense _y"):
        pattern = text.like_pattern(words)
        found.append(grams.pruned(spark, fx.indexed_documents(spark, d), pattern).filter(F.col("text").ilike(pattern)).select(F.lit(words).alias("words"), "doc_id", "source"))
    return reduce(lambda a, b: a.unionByName(b), found)


@query
def timeline_topic(spark, d):
    found = search.timeline_topic(fx.with_digests(spark, d), fx.municipalities(spark, d), "Blue Bolt", date_from="1996-03-01", limit=100)
    return found.select("meeting_id", "title", "held_on", "meeting_type", "source_url", "municipality_code", "municipality_name", "prefecture", F.posexplode("matched_topics").alias("pos", "t")).select("*", "t.topic", "t.relevance", "t.digest", F.array_join("t.speakers", ",").alias("speakers")).drop("t")


@query
def compare_topics(spark, d):
    found = search.meetings_with_topics(fx.with_digests(spark, d), ["gear", "PROMO"], fx.municipalities(spark, d), limit=40)
    return found.select("meeting_id", "title", "held_on", "meeting_type", "municipality_code", "municipality_name", "prefecture", *[F.array_join(F.element_at("matched_topics_by_query", F.lit(k)), ",").alias(f"topics_{k.lower()}") for k in ("gear", "PROMO")])


@query
def compare_topics_bare(spark, d):
    found = search.meetings_with_topics(fx.with_digests(spark, d), ["anvil", "widget", "ring"], limit=40)
    return found.select("meeting_id", "held_on", "municipality_code", F.array_join(F.element_at("matched_topics_by_query", F.lit("anvil")), ",").alias("topics_anvil"))


@query
def meeting_digest(spark, d):
    found = search.meeting_digest(fx.with_digests(spark, d), "000000000003")
    return found.select("meeting_id", "title", "held_on", "meeting_type", "source_url", "summary", F.size("topic_digests").alias("n_topics"), F.array_join(F.transform("topic_digests", lambda x: x["topic"]), ",").alias("topics"))


@query
def audit_totals(spark, d):
    return search.audit_totals(fx.with_digests(spark, d))


@query
def audit_patterns(spark, d):
    return search.audit_patterns(fx.with_digests(spark, d), ["Small Ring", "small", "economy", "absent"], limit=25)


@query
def audit_report(spark, d):
    return search.audit_report(search.audit_patterns(fx.with_digests(spark, d), ["Small Ring", "small", "economy", "absent"], limit=100000))


@query
def topic_index(spark, d):
    return topics.topic_index(fx.with_digests(spark, d))


def _members(spark, d):
    refs = topics.topic_index(fx.with_digests(spark, d))
    member = lambda name, position: F.struct(name.alias("canonical_name"), F.lit("").alias("description"), F.lit(position).cast("long").alias("position"))
    named = F.when(F.col("relevance") == "primary", member(F.element_at(F.split("topic", " "), -1), 0))
    extra = F.when(F.col("topic").startswith("small"), member(F.lit("extra"), 1))
    # one pass over the index, which stays dealt by municipality
    members = refs.select("municipality_code", F.col("index").alias("member_index"), F.explode(F.array_compact(F.array(named, extra))).alias("m"))
    return refs, members.select("municipality_code", "m.*", "member_index")


@query
def cluster_missing(spark, d):
    refs, members = _members(spark, d)
    return topics.missing(refs, members).select("municipality_code", "index", "topic")


@query
def cluster_dupes(spark, d):
    return topics.assigned_twice(_members(spark, d)[1])


@query
def cluster_topics(spark, d):
    found = topics.cluster_rows(*_members(spark, d))[0]
    return found.select("municipality_code", "canonical_name", F.array_join("aliases", ",").alias("aliases"))


@query
def cluster_links(spark, d):
    return topics.cluster_rows(*_members(spark, d))[1]


@query
def clusterer_rows(spark, d):
    refs = topics.topic_index(fx.with_digests(spark, d))
    found = topics.cluster_with(refs, topics.normalising_clusterer)
    return found.groupBy("canonical_name").agg(F.count("*").alias("members"), F.countDistinct("municipality_code").alias("municipalities"))


@query
def prompt_lines(spark, d):
    return topics.topic_index(fx.with_digests(spark, d)).select("municipality_code", topics.prompt_line().alias("line"))


# utterances

@query
def statement_offsets(spark, d):
    return chunk.offsets(fx.statements(spark, d), "meeting_id", ["position"]).select("meeting_id", "position", "start_offset", "end_offset")


@query
def speaker_runs(spark, d):
    return chunk.speaker_runs(fx.statements(spark, d), "meeting_id", ["position"]).select("meeting_id", "position", "run")


@query
def chunk_statements(spark, d):
    rows = fx.statements(spark, d).filter("kind <> 'question'")
    found = chunk.chunk_statements(rows, "meeting_id", ["position"], 900)
    return found.select("meeting_id", "run", "chunk_index", "speaker_name", "speaker_role", F.array_join("statement_ids", ",").alias("statement_ids"), F.sha2("content", 256).alias("content_hash"))


@query
def transcript(spark, d):
    return chunk.transcript(fx.statements(spark, d), "meeting_id", ["position"])


@query
def carry_speaker(spark, d):
    head = F.when(F.col("role") == "user", F.concat(F.lit("U"), F.col("turn").cast("string")))
    return chunk.carry_speaker(fx.table(spark, d, "conversations"), "conv_id", ["turn"], head).select("conv_id", "turn", "block", "under")


@query
def content_order(spark, d):
    rows = fx.statements(spark, d).withColumn("start", F.when(F.col("position") % 3 != 1, F.length("content")))
    return runs.statement_order(rows, start="start", tie="position").select("meeting_id", "position", "place")


@query
def noise_flags(spark, d):
    c = F.col("content")
    rows = fx.statements(spark, d).withColumn("content", F.concat(F.element_at(F.array(F.lit("○"), F.lit("◆"), F.lit("△"), F.lit(""), F.lit("◎"), F.lit("")), (F.col("position") % 6 + 1).cast("int")), "content"))
    return rows.select("meeting_id", "position", classify.is_procedural(c).alias("procedural"), classify.is_too_short(c, 12).alias("short"))


# cleaning

@query
def first_wins(spark, d):
    return clean.first_wins(fx.table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])


@query
def last_wins(spark, d):
    return clean.last_wins(fx.table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query
def insert_ignore(spark, d):
    """Two keys that interact: (user, hour) and (user, k of the event's properties, null for clicks); purchases are there already."""
    k = F.when(F.col("event_type") != "click", F.get_json_object("props", "$.k").cast("int"))
    e = fx.table(spark, d, "events").select("event_id", "event_type", "user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), k.alias("k"))
    new, target = e.filter("event_type <> 'purchase'").drop("event_type"), e.filter("event_type = 'purchase'")
    return clean.insert_ignore(new, target, [["user_id", "hour"], ["user_id", "k"]], [F.col("event_id")])


@query
def insert_ignore_exact(spark, d):
    e = fx.table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 300).alias("a"), F.when(F.col("event_id") % 5 != 0, F.floor(F.col("event_id") / 7) % 200).alias("b"))
    return clean.insert_ignore_exact(e, [["a"], ["b"]], "user_id", [F.col("id")])


@query
def upsert_topics(spark, d):
    p = fx.table(spark, d, "part")
    old = p.filter("p_size < 30").groupBy("p_brand", "p_name").agg(F.count("*").alias("n"), F.max("p_type").alias("description"))
    new = p.filter("p_size >= 20").groupBy("p_brand", "p_name").agg((F.count("*") * 10).alias("n"), F.min("p_type").alias("description"))
    return clean.upsert(old, new, ["p_brand", "p_name"])


@query
def keyed_update(spark, d):
    m = fx.meetings(spark, d)
    new = m.filter("meeting_type = 'committee'").select("id", F.upper("summary").alias("summary"), F.lit("x").alias("meeting_type"))
    return clean.keyed_update(m, new, "id", ["summary", "meeting_type"]).select("id", "summary", "meeting_type")


@query
def orphans_anti(spark, d):
    return clean.orphans(fx.meetings(spark, d).select("id"), fx.digests(spark, d), "id", "meeting_id")


@query
def dir_validation(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("dir"), "n_chars")
    return clean.passing_groups(docs, "dir", F.col("n_chars") < 12000)


@query
def corrected_preferred(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    return clean.corrected_preferred(docs, ["source", "lang"], F.col("n_chars") > 8000, F.col("doc_id") % 10 == 0)


@query
def meetings_by_month(spark, d):
    m = fx.meetings(spark, d).withColumn("month", F.date_format("held_on", "yyyy-MM"))
    found = chunk.group_first_seen(m, ["meeting_type", "month"], "id", F.col("title"))
    return found.select("meeting_type", "month", "first", F.size("items").alias("n"))


@query
def calendar_year(spark, d):
    m = fx.meetings(spark, d).select("id", "held_on")
    fiscal = [m.filter(dates.fiscal_year("held_on") == y) for y in (1996, 1997)]
    return clean.union_calendar_year(fiscal, "held_on", 1997)


@query
def truncated_lists(spark, d):
    m = fx.meetings(spark, d).select("municipality_code", "id")
    return runs.first_k(m, ["municipality_code"], [F.col("id")], 5)


@query
def failures_by_system(spark, d):
    p = fx.table(spark, d, "pages").withColumn("failed", F.col("page_id") % 7 == 0)
    return runs.failures_by_system(p, code=F.lit("custom")).withColumnRenamed("attempts", "pages")


# limits

@query
def rate_demand(spark, d):
    return limits.demand(fx.table(spark, d, "events"), "user_id", "ts", 86400).select("event_id", "in_window")


@query
def rate_admission(spark, d):
    return limits.admission(fx.table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 86400, 2).select("event_id", "admitted", "remaining")


@query
def usage_json(spark, d):
    return fx.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query
def token_cost(spark, d):
    c = fx.table(spark, d, "conversations").groupBy(F.col("role").alias("model")).agg(F.sum(F.length("text")).alias("input_tokens"), F.count("*").alias("output_tokens"))
    prices = spark.createDataFrame([("user", 0.3, 2.5), ("assistant", 1.25, 10.0)], "model string, price_in double, price_out double")
    return topics.token_cost(c, prices).withColumn("cost", F.round("cost", 6))


# pages and texts

@query
def page_anchors(spark, d):
    return fx.table(spark, d, "pages").select("page_id", F.posexplode(text.anchors("html")).alias("pos", "a")).select("page_id", "pos", "a.href", "a.label")


@query
def page_text(spark, d):
    return fx.table(spark, d, "pages").select("page_id", F.sha2(text.strip_html("html"), 256).alias("text_hash"))


@query
def page_lines(spark, d):
    return fx.table(spark, d, "pages").select("page_id", F.sha2(text.strip_tags("html"), 256).alias("text_hash"))


@query
def page_host(spark, d):
    p = fx.table(spark, d, "pages").select("page_id", text.host("url").alias("host"))
    return p.select("page_id", "host", text.group_key("host").alias("group_key"))


@query
def page_route(spark, d):
    u = F.concat("url", F.element_at(F.array(*[F.lit(x) for x in ("", "/tenant/a/", "/VOICES/x", "?h=dbsr.jp", "?h=kensakusystem.jp", "?h=kensakusystem.jp/a-vod/", "/g08v_search.asp")]), (F.col("page_id") % 7 + 1).cast("int")))
    return fx.table(spark, d, "pages").select("page_id", text.adapter_key(u, F.col("page_id").cast("string")).alias("system"))


@query
def heading_carry(spark, d):
    p = fx.table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?i)<(?:h1|p)>[^<]*"), F.lit(0))).alias("pos", "block"))
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.lower("block").startswith("<h1>"), F.substring("block", F.lit(5), F.length("block")))
    return p.select("page_id", "pos", F.last(head, ignorenulls=True).over(w).alias("heading"), F.length("block").alias("n"))


@query
def content_hash(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", text.content_hash("text").alias("hash"), text.content_hash("text", F.col("doc_id").cast("string")).alias("prefixed_hash"))


@query
def short_id(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", text.short_id("text").alias("short_id"), text.composite_id("sys", "source", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id"))).alias("external_id"))


@query
def squeezed(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.sha2(text.squeeze("text"), 256).alias("hash"), F.size(text.tokens("text")).alias("tokens"))


@query
def previews(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", text.left("text", 200).alias("p200"), text.text_before("text", "the", 30).alias("before_the"))


@query
def digits_normalise(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", text.full_width_digits(F.col("n_chars").cast("string")).alias("full"), text.half_width_digits(F.concat(text.full_width_digits(F.col("doc_id").cast("string")), F.lit("号"))).alias("half"))


@query
def utf16_length(spark, d):
    return fx.table(spark, d, "benchmark").select("item_id", text.length_utf16(F.concat("text", F.lit("𠮷野"))).alias("units"), F.length(F.concat("text", F.lit("𠮷野"))).alias("points"))


# dates and classes

def _orders(spark, d):
    o = fx.table(spark, d, "orders")
    return o.select("o_orderkey", (F.year("o_orderdate") + 20).alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("day"))


@query
def era_date(spark, d):
    o = _orders(spark, d)
    era = F.when(F.col("y") >= 2019, F.concat(F.lit("令和"), (F.col("y") - 2018).cast("string"))).otherwise(F.concat(F.lit("平成"), (F.col("y") - 1988).cast("string")))
    s = F.concat(F.lit("第１回 "), era, F.lit("年"), text.full_width_digits(F.col("m").cast("string")), F.lit("月"), F.col("day").cast("string"), F.lit("日"))
    return o.select("o_orderkey", dates.era_date(s).alias("iso"), dates.valid_date(dates.era_date(s)).alias("day"), dates.label_year(s).alias("year"))


@query
def sitting_date(spark, d):
    o = _orders(spark, d)
    kanji = lambda c: F.concat(F.when(c >= 20, F.substring(F.lit(dates.KANJI), F.floor(c / 10).cast("int") + 1, F.lit(1))).otherwise(""), F.when(c >= 10, "十").otherwise(""), F.when(c % 10 > 0, F.substring(F.lit(dates.KANJI), (c % 10).cast("int") + 1, F.lit(1))).otherwise(""))
    s = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("<b>平成"), kanji(F.col("y") - 1988), F.lit("年"), kanji(F.col("m")), F.lit("月"), kanji(F.col("day")), F.lit("日</b>")))
    s = s.when(F.col("o_orderkey") % 3 == 1, F.concat(F.col("y").cast("string"), F.lit("年（平成）"), F.col("m").cast("string"), F.lit("月"), F.col("day").cast("string"), F.lit("日")))
    s = s.otherwise(F.concat(F.lit("平成"), (F.col("y") - 1988).cast("string"), F.lit("年\n会議\n"), F.col("m").cast("string"), F.lit("月"), F.col("day").cast("string"), F.lit("日")))
    return o.select("o_orderkey", dates.sitting_date(s).alias("iso"), dates.kanji_number(kanji(F.col("day"))).alias("day"))


@query
def filename_date(spark, d):
    o = _orders(spark, d)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    s = F.concat(F.when(F.col("y") >= 2019, F.lit("R")).otherwise("h"), two(F.when(F.col("y") >= 2019, F.col("y") - 2018).otherwise(F.col("y") - 1988)), two(F.col("m") % 7), two(F.col("day")), F.lit("B02"))
    return o.select("o_orderkey", dates.filename_date(s).alias("iso"))


@query
def era_labels(spark, d):
    return _orders(spark, d).select("y").distinct().select("y", F.array_join(dates.era_labels("y"), ",").alias("labels"))


@query
def meeting_type(spark, d):
    title = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("総務委員会", "臨時会", "定例会", "臨時委員会", "臨時")]), (F.col("doc_id") % 5 + 1).cast("int")), F.col("lang"))
    return fx.table(spark, d, "documents").select("doc_id", *[classify.meeting_type(title, r).alias(r) for r in classify.MEETING_TYPE_RULES])


@query
def utterance_kind(spark, d):
    role = F.element_at(F.array(*[F.lit(x) for x in ("市長", "総務部長", "議長", "予算委員長", "山田議員", "１７番", "調査員", "", "環境センター長")]), (F.col("doc_id") % 9 + 1).cast("int"))
    mark = F.element_at(F.array(F.lit("◎"), F.lit("○"), F.lit("◆")), (F.col("doc_id") % 3 + 1).cast("int"))
    return fx.table(spark, d, "documents").select("doc_id", classify.utterance_kind(role).alias("plain"), classify.utterance_kind(role, "question").alias("asks"), classify.utterance_kind_marked(role, mark).alias("marked"), classify.utterance_kind_tree(role).alias("tree"), classify.normal_role(role).alias("suffix"))


@query
def speaker_header(spark, d):
    role = F.element_at(F.array(*[F.lit(x) for x in ("◎総務部長（山田君）", "○17番（佐藤 花子さん）", "◆川田　委員", "○議長", "none")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return fx.table(spark, d, "documents").select("doc_id", speakers.marked_header(role).alias("h")).select("doc_id", "h.role", "h.name", "h.marker")


# plain Spark, offered beside the reference's queries

def _cosine(a, b):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b))


@query
def cosine_topk(spark, d):
    e = fx.table(spark, d, "embeddings")
    probe = e.filter("vec_id = 0").select(F.col("embedding").alias("probe"))  # one row
    scored = e.filter("vec_id <> 0").crossJoin(F.broadcast(probe)).select("vec_id", F.round(_cosine(F.col("embedding"), F.col("probe")), 4).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(10)


@query
def extra_rollup(spark, d):
    return fx.meetings(spark, d).rollup("meeting_type", F.year("held_on").alias("year")).agg(F.count("*").alias("n"), F.countDistinct("municipality_code").alias("municipalities"))


@query
def extra_cube(spark, d):
    return fx.table(spark, d, "part").cube("p_brand", "p_type").agg(F.count("*").alias("n"))


@query
def extra_outer_join(spark, d):
    n = fx.meetings(spark, d).groupBy("municipality_code").agg(F.count("*").alias("n"))
    m = fx.municipalities(spark, d).select("code")
    return m.join(n, m.code == n.municipality_code, "full").select("code", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query
def extra_set_ops(spark, d):
    a, b = [fx.meetings(spark, d).filter(f"meeting_type = '{k}'").select("municipality_code") for k in ("committee", "plenary")]
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("committee")))


@query
def extra_tumbling(spark, d):
    e = fx.table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")


