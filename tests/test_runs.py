"""Operators that go on in rounds or streams against plain Python; calls, tools and addresses without services."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import shape
from quorumlake.operators import clean, limits, replies, tools
from quorumlake.sources import database, ndjson


def inserted(rows, target, keys):
    """Rows that a database adds, one after the other."""
    seen = [{tuple(t[i] for i in key) for t in target if all(t[i] is not None for i in key)} for key in keys]
    out = []
    for r in rows:
        own = [tuple(r[i] for i in key) if all(r[i] is not None for i in key) else None for key in keys]
        if any(k is not None and k in s for k, s in zip(own, seen, strict=True)):
            continue
        for k, s in zip(own, seen, strict=True):
            if k is not None:
                s.add(k)
        out.append(r)
    return out


def test_insert_ignore_where_keys_interact(spark):
    schema = "id long, u long, x long, place long"
    for seed in (1, 2):
        rng = random.Random(seed)
        pick = lambda n: rng.choice([None, *range(n)])
        rows = [(pick(60), pick(4), pick(20), i // 2) for i in range(150)]
        target = [(7, 1, 1, 0), (None, 2, None, 0), (50, None, 3, 0)]
        got = [tuple(r) for r in clean.insert_ignore(spark.createDataFrame(rows, schema).coalesce(1), spark.createDataFrame(target, schema), [["id"], ["u", "x"]], [F.col("place")]).collect()]
        assert sorted(got, key=str) == sorted(inserted(rows, target, [(0,), (1, 2)]), key=str)
    few = spark.createDataFrame([(1, 0, 1, 0), (2, 0, 1, 1), (2, 0, 2, 2)], schema)
    got = clean.insert_ignore(few, None, [["id"], ["u", "x"]], [F.col("place")]).collect()
    assert sorted(r.place for r in got) == [0, 2]
    assert clean.insert_ignore(few.limit(0), None, [["id"]], [F.col("place")]).count() == 0


def test_admission_of_a_hot_key(spark):
    rng, start = random.Random(5), datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", start + timedelta(seconds=rng.randrange(4000))) for i in range(600)]
    got = {r.n: (r.admitted, r.remaining) for r in limits.admission(spark.createDataFrame(rows, "n long, key string, ts timestamp_ntz"), "key", "ts", "n", 60, 2).collect()}
    logs: dict = {}
    for n, key, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        log = [t for t in logs.get(key, []) if t > ts - timedelta(seconds=60)]
        assert got[n] == (len(log) < 2, 1 - len(log) if len(log) < 2 else 0)
        logs[key] = [*log, ts] if len(log) < 2 else log


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise RuntimeError(["503 UNAVAILABLE", 'x {"retryDelay": "1.5s"} 429', "request timed out"][len(calls) - 1])
        return "done"

    assert replies.with_retry(call, sleep=waits.append, jitter=lambda: 0.0) == "done" and waits == [1.0, 1.5, 4.0]
    with pytest.raises(RuntimeError, match="bad key"):
        replies.with_retry(lambda: (_ for _ in ()).throw(RuntimeError("bad key")), sleep=waits.append)
    calls.clear()
    with pytest.raises(RuntimeError):
        replies.with_retry(lambda: calls.append(1) or (_ for _ in ()).throw(RuntimeError("502")), attempts=3, sleep=lambda _: None)
    assert len(calls) == 3


def test_summariser_keeps_going_past_errors(spark):
    def client(title, text):
        if title == "b":
            raise ValueError("refused")
        return json.dumps({"summary": text, "topic_digests": []})

    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, title string, transcript string")
    got = {r.id: (r.reply, r.error) for r in replies.summarise(df, client).collect()}
    assert got[2] == (None, "refused") and json.loads(got[1][0])["summary"] == "x"


def test_tools_and_loop(spark):
    digest = "array<struct<topic:string,relevance:string,digest:string,speakers:array<string>>>"
    rows = [("m1", "01", "T", "2024-01-01", "plenary", None, "s", [("Park", "primary", "a park", ["A"])]), ("m2", "02", "U", "2024-02-01", "plenary", None, None, None)]
    m = spark.createDataFrame(rows, f"id string, municipality_code string, title string, held_on string, meeting_type string, source_url string, summary string, topic_digests {digest}").withColumn("held_on", F.col("held_on").cast("date"))
    box = tools.Toolbox(m, "01")
    assert box.call("search_topics", {"query": "park"})["rows"][0]["meeting_id"] == "m1"
    assert box.call("search_topics", {"query": "park", "municipality_code": "02"}) == {"rows": []}
    assert box.call("get_meeting_digest", {"meeting_id": "m2"})["topic_digests"] == [] and box.call("get_meeting_digest", {"meeting_id": "x"}) == {"error": "not found"}
    assert box.call("find_meetings_with_topics", {"topics": ["park"]})["rows"][0]["meeting_id"] == "m1"
    assert box.call("nothing", None) == {"error": "unknown function: nothing"} and "limit" in box.call("search_topics", {"query": "x", "limit": 1000})["error"]

    def model(messages):
        if len(messages) == 1:
            return {"calls": [("search_topics", {"query": "park"})], "input_tokens": 10, "output_tokens": 2}
        return {"text": f"{len(messages[-1]['result']['rows'])} found", "input_tokens": 20, "output_tokens": 3}

    run = tools.ask("parks?", model, box)
    assert (run.answer, run.end_reason, run.calls, run.input_tokens, run.output_tokens) == ("1 found", "final_answer", 2, 30, 5)
    endless = tools.ask("?", lambda _: {"calls": [("nothing", {})]}, box, most=3)
    assert endless.end_reason == "max_iterations" and endless.calls == 3 and len(endless.steps) == 3


def test_addresses_of_databases():
    a = database.parse_url("postgres://user:p@ss:w@db.example:6543/main?sslmode=disable")
    assert (a.host, a.port, a.database, a.user, a.password) == ("db.example", 6543, "main", "user", "p@ss:w")
    assert database.parse_url("postgresql://u:p@h").port == 5432 and database.parse_url("postgresql://u:p@h/").database == "postgres"
    options = database.reader_options("postgresql://u:p@h/d", "meetings", ("held_on", "2000-01-01", "2030-01-01", 8))
    assert options["numPartitions"] == "8" and options["url"] == "jdbc:postgresql://h:5432/d?prepareThreshold=0"


def test_markers_written_and_read(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("2024", "01", i, json.dumps({"id": f"a{i}", "heldOn": "2024-01-01", "municipalityCode": "01"})) for i in range(3)] + [("2023", "02", 0, "{broken")], "year string, code string, place long, line string")
    ndjson.land(rows, root, ndjson.MEETINGS)
    assert (tmp_path / "2024" / "01" / "meetings.ndjson").read_text().count("\n") == 3
    folders = spark.createDataFrame([("2024", "01", 3, 0, False), ("2023", "02", 1, 0, False), ("2022", "03", 1, 0, True)], "year string, code string, meetings int, statements int, truncated boolean")
    ndjson.mark_complete(root, folders)
    added, outcome = ndjson.import_meetings(spark, root)
    assert sorted(r.id for r in added.collect()) == ["a0", "a1", "a2"] and {(r.code, r.ok) for r in outcome.collect()} == {("01", True), ("02", False)}
    ndjson.mark_imported(root, outcome.filter("ok"))
    assert {(r.code, r.imported, r.meetings) for r in ndjson.markers(spark, root).collect()} == {("01", True, 3), ("02", False, 1)}
    assert [r.code for r in ndjson.import_targets(spark, root).collect()] == ["02"]
    ndjson.mark_summaries_imported(root, folders.limit(1))
    assert [r.imported for r in ndjson.markers(spark, root, ndjson.SUMMARIES_COMPLETE).collect()] == [True]


def test_imported_rows_carry_their_place_once(spark, tmp_path, monkeypatch):
    """no table of an import's rounds holds folders' names or the order beside the rows; of one id the first folder's first line stays."""
    root, held, write = str(tmp_path), [], clean.cut

    def spy(df):
        held.append(df.columns)
        return write(df)

    monkeypatch.setattr(clean, "cut", spy)
    said = lambda i, x: json.dumps({"id": i, "heldOn": "2024-01-01", "municipalityCode": "m", "externalId": x})
    folders = [("2024", "9"), ("2024", "10"), ("2023", "a"), ("2024", "1")]
    lines = [(y, c, n, said(f"id{n % 3}", f"{y}-{c}-{n}")) for y, c in folders for n in range(12)] + [("2024", "9", 12, said("new", "2023-a-0")), ("2024", "9", 13, said("new", "2024-10-0"))]
    ndjson.land(spark.createDataFrame(lines, "year string, code string, place long, line string"), root, ndjson.MEETINGS)
    ndjson.mark_complete(root, spark.createDataFrame([(y, c, 12, 0, False) for y, c in folders], "year string, code string, meetings int, statements int, truncated boolean"))
    added = ndjson.import_meetings(spark, root)[0].collect()
    assert sorted((r.id, r.external_id) for r in added) == [("id0", "2023-a-0"), ("id1", "2023-a-1"), ("id2", "2023-a-2"), ("new", "2024-10-0")]
    assert held and not {c for columns in held for c in columns} & {"_at", "_f0", "_f1", "year", "code", "line_no"}


def test_shapes_of_odd_texts(spark):
    df = spark.createDataFrame([("",), ("12",), ("短い行\n" * 10 + "これは文です。",), ("a\n\n「x」y",), (None,)], "t string")
    got = [r.t for r in df.select(shape.page_body("t").alias("t")).collect()]
    assert got == ["", "", "短い行\n短い行\nこれは文です。", "「x」y", None]
    s = spark.createDataFrame([("no heading",), ("<h3>a</h3>",)], "t string").select(shape.sections("t").alias("s")).collect()
    assert [[tuple(x) for x in r.s] for r in s] == [[], [("a", "")]]


def test_amounts_are_no_status(spark):
    said = ["Please retry in 503.25s", "Please retry in 429.00ms", "retry in 7.500s", "no 500.", "429", "error 503: busy", "code=502,", "UNAVAILABLE", "1503"]
    df = spark.createDataFrame(list(enumerate(said)), "i int, said string").select("i", replies.is_retryable("said").alias("again")).orderBy("i")
    assert [r.again for r in df.collect()] == [False, False, False, True, True, True, True, True, False]
    assert [bool(replies.RETRYABLE.search(s)) for s in said] == [False, False, False, True, True, True, True, True, False]
