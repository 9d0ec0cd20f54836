import datetime
import json
import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quorumlake import schemas
from quorumlake.functions import text
from quorumlake.operators import chunk, clean, grams, graph, limits, topics
from quorumlake.plans import search
from quorumlake.sources import ndjson, pages
from quorumlake.streaming import usage

STATEMENT = "meeting_id string, position int, id string, speaker_name string, speaker_role string, content string"


def statements(spark, rows):
    return spark.createDataFrame([("m", i, str(i), who, "role", said) for i, (who, said) in enumerate(rows)], STATEMENT)


def chunks(spark, rows, **k):
    got = chunk.chunk_statements(statements(spark, rows), **k).orderBy("run", "chunk_index").collect()
    return [(r.speaker_name, r.statement_ids, r.content) for r in got]


def test_chunks_by_speaker(spark):
    assert chunks(spark, [("A", "甲甲甲甲甲"), ("A", "乙乙乙乙乙"), ("B", "丙丙丙丙丙")]) == [("A", ["0", "1"], "甲甲甲甲甲\n乙乙乙乙乙"), ("B", ["2"], "丙丙丙丙丙")]


def test_noise_between_two_of_one_speaker_joins_them(spark):
    assert [c[1] for c in chunks(spark, [("A", "甲甲甲甲甲"), ("B", "○議長発言です"), ("A", "乙乙乙乙乙")])] == [["0", "2"]]


def test_chunk_sizes(spark):
    sizes = [800, 800, 4]
    assert [c[1] for c in chunks(spark, [("A", "x" * n) for n in sizes], drop_noise=False)] == [["0"], ["1", "2"]]
    assert [c[1] for c in chunks(spark, [("A", "x" * n) for n in (700, 800)])] == [["0", "1"]]
    assert [c[1] for c in chunks(spark, [("A", "x" * n) for n in (701, 800)])] == [["0"], ["1"]]
    assert [c[1] for c in chunks(spark, [("A", "x" * n) for n in (2000, 5)])] == [["0"], ["1"]]
    assert chunks(spark, [("A", "○x"), ("B", "△y")]) == []


def test_null_speakers_are_one(spark):
    assert [c[1] for c in chunks(spark, [(None, "甲甲甲甲甲"), (None, "乙乙乙乙乙"), ("", "丙丙丙丙丙")])] == [["0", "1"], ["2"]]


def greedy(sizes, most):
    want, held, now = [], 0, -1
    for n in sizes:
        if now < 0 or held + n > most:
            now, held = now + 1, n
        else:
            held += n
        want.append(now)
    return want


def test_greedy_against_loop(spark):
    """Runs of many lengths, empty statements, ones longer than a chunk, a meeting without an id, ties in order."""
    rng = random.Random(1)
    rows, want = [], {}
    for m, count in enumerate((1, 2, 40, 300)):
        sizes = [rng.choice([0, 0, rng.randrange(1, 90), rng.randrange(1, 20), 120]) for _ in range(count)]
        meeting = f"m{m}" if m != 2 else None
        rows += [(meeting, i // 2, f"{i:04d}", "A", "role", "x" * n) for i, n in enumerate(sizes)]
        for i, c in enumerate(greedy(sizes, 100)):
            want.setdefault((meeting, c), []).append(f"{i:04d}")
    got = chunk.chunk_statements(spark.createDataFrame(rows, STATEMENT).repartition(5), most=100, drop_noise=False)
    assert {(r.meeting_id, r.chunk_index): r.statement_ids for r in got.collect()} == want


def test_a_very_long_run(spark):
    """100,000 statements of one speaker."""
    sizes = [1 + i * 7919 % 299 for i in range(100_000)]
    rows = spark.range(100_000).select(F.lit("m").alias("meeting_id"), F.col("id").cast("int").alias("position"), F.format_string("%06d", "id").alias("id"), F.lit("A").alias("speaker_name"), F.lit("r").alias("speaker_role"), F.repeat(F.lit("x"), (1 + F.col("id") * 7919 % 299).cast("int")).alias("content"))
    got = {r.chunk_index: (r.first, r.n) for r in chunk.chunk_statements(rows, drop_noise=False).select("chunk_index", F.col("statement_ids")[0].alias("first"), F.size("statement_ids").alias("n")).collect()}
    want: dict = {}
    for i, c in enumerate(greedy(sizes, 1500)):
        want[c] = (want.get(c, (f"{i:06d}", 0))[0], want.get(c, ("", 0))[1] + 1)
    assert got == want


def test_insert_ignore_keys(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (2, "a", "x"), (3, "a", None), (4, "a", None), (5, "b", "x")]
    df = spark.createDataFrame(rows, "id long, code string, ext string")
    got = clean.insert_ignore(df, None, [["id"], ["code", "ext"]], [F.col("id"), F.col("ext")])
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 5]
    target = spark.createDataFrame([(9, "b", "x"), (4, "z", None)], "id long, code string, ext string")
    assert sorted(r.id for r in clean.insert_ignore(df, target, [["id"], ["code", "ext"]], [F.col("id"), F.col("ext")]).collect()) == [1, 3]


def test_insert_ignore_exact_against_loop(spark):
    rng = random.Random(4)
    rows = [(i, "g" + str(i % 3), rng.randrange(12), rng.choice([None, *range(9)])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g string, a long, b long")
    got = {r.id for r in clean.insert_ignore_exact(df, [["a"], ["b"]], "g", [F.col("id")]).collect()}
    want, seen = set(), set()
    for i, g, a, b in rows:
        keys = {(g, "a", a), *([(g, "b", b)] if b is not None else [])}
        if not keys & seen:
            want.add(i)
            seen |= keys
    assert got == want


def test_insert_ignore_of_a_long_chain(spark):
    """Each row shares a key with the next: every second one stays, found without a round for each."""
    n = 10_000
    rows = spark.range(n).select("id", F.expr("id div 2").alias("a"), F.expr("(id + 1) div 2").alias("b"))
    got = sorted(r.id for r in clean.insert_ignore(rows.repartition(4), None, [["a"], ["b"]], [F.col("id")]).collect())
    assert got == list(range(0, n, 2))


def test_insert_ignore_by_groups_and_by_rounds(spark):
    """Groups decided at once, and groups that are too large for that, against a loop."""
    rng = random.Random(3)
    rows = [(i, rng.choice([None, *range(40)]), rng.randrange(60)) for i in range(150)] + [(150 + i, 1000 + i // 2, 1000 + (i + 1) // 2) for i in range(30)]
    want, seen = [], set()
    for i, a, b in rows:
        own = {("b", b), *([("a", a)] if a is not None else [])}
        if not own & seen:
            seen |= own
            want.append(i)
    df = spark.createDataFrame(rows, "id long, a long, b long")
    for rounds, most in ((0, 1000), (0, 3), (1, 5), (2, 0)):
        assert sorted(r.id for r in clean.insert_ignore(df, None, [["a"], ["b"]], [F.col("id")], rounds, most).collect()) == want, (rounds, most)


def test_connected_groups(spark):
    """Paths with numbers in and out of order, stars and rings, in few rounds."""
    rng = random.Random(7)
    links, groups = [], []
    for base, order in ((0, list(range(200))), (1000, rng.sample(range(200), 200))):
        links += [(base + a, base + b) for a, b in zip(order, order[1:], strict=False)]
        groups.append({base + x for x in order})
    links += [(2000, 2000 + i) for i in range(1, 9)] + [(3001, 3002), (3002, 3003), (3003, 3001), (3001, 3001)]
    groups += [set(range(2000, 2009)), {3001, 3002, 3003}]
    got = {r.v: r.least for r in graph.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: min(g) for g in groups for v in g}


def test_substring_index(spark, tmp_path):
    """Fewer blocks are read, and the rows are those of a search of the whole table."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéÉ漢😀") for _ in range(rng.randrange(1, 9)))
    rows = [(i, None if i % 50 == 3 else " ".join(word() for _ in range(rng.randrange(0, 12))), "x%_\\y" if i == 77 else None) for i in range(400)]
    df, path = spark.createDataFrame(rows, "id long, t string, u string"), str(tmp_path / "index")
    grams.write_blocks(df, path, ["id"], [F.col("t"), F.col("u")], 20, 5)
    read = []
    for words in ("ab", "abc", "ABCD", "é漢", "É漢a", "😀😀", "a%b", "abc%dea", "c_d", "x\\%\\_", "nowhere", "", "%", rows[9][1][:12]):
        pattern = text.like_pattern(words)
        hit = F.coalesce(F.col("t").ilike(pattern), F.lit(False)) | F.coalesce(F.col("u").ilike(pattern), F.lit(False))
        some = grams.pruned(spark, path, pattern, buckets=5)
        assert sorted(r.id for r in some.filter(hit).collect()) == sorted(r.id for r in df.filter(hit).collect()), words
        read.append(some.select(F.input_file_name()).distinct().count())
    assert read[0] == 20 and min(read) == 0 and sorted(read)[4] < 10
    assert grams.literal_runs("%ab\\%c_d%") == ["ab%c", "d"]


def test_upsert_and_update(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, n int, d string")
    new = spark.createDataFrame([("b", None, "y"), ("c", 3, "z")], "k string, n int, d string")
    assert sorted(map(tuple, clean.upsert(old, new, ["k"]).collect())) == [("a", 1, "x"), ("b", None, "y"), ("c", 3, "z")]
    assert sorted(map(tuple, clean.keyed_update(old, new, "k", ["d"]).collect()), key=str) == [("a", 1, "x"), ("b", 2, "y")]
    assert [r.k for r in clean.orphans(new, old, "k", "k").collect()] == ["c"]


def test_rate_limits(spark):
    t0 = datetime.datetime(2024, 1, 1)
    at = [0, 1, 2, 3, 4, 5, 600, 601, 602]
    rows = [(i, "u", t0 + datetime.timedelta(seconds=s)) for i, s in enumerate(at)] + [(99, "v", t0)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz")
    got = {r.id: r for r in limits.admission(df, "key", "ts", "id", 600, 5).collect()}
    assert [got[i].admitted for i in range(9)] == [True] * 5 + [False, True, True, True]
    assert [got[i].remaining for i in (0, 4, 5, 6)] == [4, 0, 0, 0] and got[5].retry_us == 595_000_000
    assert got[99].admitted and got[99].remaining == 4
    assert not any(r.admitted for r in limits.admission(df, "key", "ts", "id", 600, 0).collect())
    assert {r.id: r.in_window for r in limits.demand(df, "key", "ts", 600).collect()}[6] == 6


def test_stream_agrees_with_batch(spark, tmp_path):
    """Files in no order of time over several triggers, and a last event that moves the watermark on."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "ts")
    events.repartition(5, F.xxhash64("event_id")).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(-1, -1, datetime.datetime(2030, 1, 1))], events.schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = usage.admission_stream(stream, "user_id", "ts", "event_id", 86400, 2, "60 days").writeStream.format("memory").queryName("admitted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p.numInputRows]) >= 3
    got = {r.event_id: r.admitted for r in spark.table("admitted").collect()}
    want = {r.event_id: r.admitted for r in limits.admission(events, "user_id", "ts", "event_id", 86400, 2).collect()}
    assert got == want and False in got.values()


def test_a_hot_key_is_judged_in_many_segments(spark):
    """Cut into segments of some events, with and without breaks between them, verdicts stay the same; null times and keys too."""
    rng = random.Random(8)
    t, rows = 0, []
    for i in range(3000):
        t += rng.choice([0, 1, 2, 3, 30 if i % 400 else 90])
        rows.append((i, rng.choice(["hot", "hot", "hot", "b", None]), None if i % 97 == 0 else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz")
    for most in (0, 1, 5):
        whole = sorted(map(str, limits.admission(df, "key", "ts", "id", 60, most).collect()))
        assert whole == sorted(map(str, limits.admission(df.repartition(7), "key", "ts", "id", 60, most, segment_events=200).collect()))


def test_an_import_that_fails_after_its_write(spark, tmp_path):
    root = str(tmp_path / "table")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": 1}\n')
    run = lambda sink: usage.import_new_files(spark, str(tmp_path / "in"), "id long", str(tmp_path / "c"), sink)
    seen = lambda: sorted(r.id for r in usage.committed(spark, root, "id long").collect())
    sink = usage.once(root)

    def stopped(df, number):
        sink(df, number)
        raise OSError("stopped")

    def halfway(df, number):
        df.write.parquet(f"{root}/data/left-over")
        raise OSError("stopped")

    assert seen() == []
    for bad, then in ((halfway, []), (stopped, [1])):
        with pytest.raises(StreamingQueryException):
            run(bad)
        assert seen() == then
    run(sink)
    assert seen() == [1]
    (tmp_path / "in/b.json").write_text('{"id": 2}\n')
    run(sink)
    assert seen() == [1, 2]


def test_writes_touch_what_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    old = [(k, f"p{k % 4}", k) for k in range(40)] + [(99, None, 1), (98, "alone", 1)]
    spark.createDataFrame(old, "k long, p string, n long").repartition(1).write.partitionBy("p").parquet(path)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    rows = lambda: sorted((r.k, r.p, r.n) for r in spark.read.parquet(path).filter("p is not null").collect()) + [(r.k, r.n) for r in spark.read.parquet(path).filter("p is null").collect()]
    before = files()
    new = spark.createDataFrame([(1, "p1", 100), (98, "fresh", 7), (200, "p1", 5)], "k long, p string, n long")
    assert set(clean.upsert_into(spark, path, new, ["k"], "p")) == {"p1", "alone", "fresh"}
    after = files()
    assert all(after[f] == t for f, t in before.items() if "p=p1" not in f and "alone" not in f)
    assert not any("alone" in f for f in after) and any("fresh" in f for f in after)
    held = {k: (p, n) for k, p, n in old} | {1: ("p1", 100), 98: ("fresh", 7), 200: ("p1", 5)}
    assert rows() == sorted((k, p, n) for k, (p, n) in held.items() if p) + [(99, 1)]
    assert clean.update_into(spark, path, spark.createDataFrame([(2, 2), (99, 50), (777, 1)], "k long, n long"), "k", ["n"], "p") == [None]
    assert rows()[-1] == (99, 50) and clean.update_into(spark, path, new.limit(0), "k", ["n"], "p") == []
    assert all(files()[f] == t for f, t in after.items() if "HIVE" not in f)


def test_line_numbers_of_split_files(spark, tmp_path):
    """A file of many byte ranges keeps its line numbers; only the folders asked for are listed."""
    for year, code, n in (("2023", "000001", 50), ("2024", "000001", 3000), ("2024", "000002", 10)):
        d = tmp_path / year / code
        d.mkdir(parents=True)
        lines = ["" if i % 50 == 7 else json.dumps({"id": f"{i}", "meetingId": f"m{i % 3}" if year == "2024" else "old", "content": "x" * (i % 90), "startOffset": None if i % 5 == 0 else i}) for i in range(1, n + 1)]
        (d / "statements.ndjson").write_bytes(("\r\n" if code == "000002" else "\n").join(lines).encode() + b"\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = ndjson.lines(spark, str(tmp_path), ndjson.STATEMENTS).collect()
        one = ndjson.read_statements(spark, str(tmp_path), [2024], ["000001"])
        assert one.count() == 2940 and one.rdd.getNumPartitions() > 20
        read = [f for f in one.inputFiles() if f.endswith("ndjson")]
        assert len(read) == 1 and "/2024/000001/" in read[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3060 and all((r.line == "") == (r.line_no % 50 == 7) and (not r.line or json.loads(r.line)["id"] == str(r.line_no)) for r in got)
    found = ndjson.statements_of(spark, str(tmp_path), "m1", 2024)
    assert all("/2024/" in f for f in found.inputFiles() if f.endswith("ndjson")) and [r.line_no for r in found.limit(2).collect()] == [1, 4]
    assert {r.year for r in ndjson.statements_of(spark, str(tmp_path), "old", 2024).collect()} == {"2023"} and ndjson.statements_of(spark, str(tmp_path), "none", 2024).count() == 0
    assert ndjson.lines(spark, str(tmp_path), ndjson.SUMMARIES).count() == 0


def test_a_table_written_anew_is_read_anew(spark, tmp_path):
    """What is made from tables once for a session is made again when one of them has changed."""
    from quorumlake.plans import fixtures, ingest

    for name in ("orders", "lineitem", "part", "customer"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    d = str(tmp_path)
    first, landed = fixtures.with_digests(spark, d), ingest.landed(spark, d)
    assert first.count() > 10 and ingest.landed(spark, d) == landed
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(10).write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
    assert fixtures.with_digests(spark, d).count() == 10 and ingest.landed(spark, d) != landed
    assert first.count() > 10


def test_files_are_imported_once(spark, tmp_path):
    seen = []
    (tmp_path / "in").mkdir()
    run = lambda: usage.import_new_files(spark, str(tmp_path / "in"), "id long", str(tmp_path / "c"), lambda df, _: seen.extend(r.id for r in df.collect()))
    (tmp_path / "in/a.json").write_text('{"id": 1}\n')
    run()
    (tmp_path / "in/b.json").write_text('{"id": 2}\n')
    run()
    assert seen == [1, 2]


def folder(root: Path, year: str, code: str, meetings=None, statements=None, marker=None, summaries=None) -> None:
    d = root / year / code
    d.mkdir(parents=True)
    for name, rows in (("meetings.ndjson", meetings), ("statements.ndjson", statements), ("summaries.ndjson", summaries)):
        if rows is not None:
            (d / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    if marker is not None:
        (d / "_complete").write_text(marker)


def test_partitions(spark, tmp_path):
    m, s = [{"id": "a", "heldOn": "2024-01-02"}], [{"meetingId": "a", "content": "x", "startOffset": 200}, "", {"meetingId": "a", "content": "y", "startOffset": 100}, {"meetingId": "a", "content": "z"}]
    folder(tmp_path, "2024", "000001", m, s, "{}")
    folder(tmp_path, "2024", "000002", m, s, '{"imported": true}')
    folder(tmp_path, "2024", "000003", m, s)
    folder(tmp_path, "2023", "000001", [{"id": "b"}, {"id": "c"}], [{"meetingId": "b"}], "not json")
    folder(tmp_path, "2022", "000001", ["oops"], [], "{}")
    folder(tmp_path, "2021", "000001", m, None, "{}")
    folder(tmp_path, "2020", "000001", [{"id": "q"}], [{"meetingId": "q", "content": "w"}], "{}", [{"meetingId": "q", "summary": "1", "topicDigests": []}, "", {"meetingId": "q", "summary": "2", "topicDigests": []}])
    root = str(tmp_path)
    places = lambda df: sorted((r.year, r.code) for r in df.collect())
    assert places(ndjson.import_targets(spark, root)) == [("2020", "000001"), ("2021", "000001"), ("2022", "000001"), ("2023", "000001"), ("2024", "000001")]
    assert ("2024", "000002") in places(ndjson.import_targets(spark, root, skip_imported=False))
    assert places(ndjson.import_targets(spark, root, ["000002"], False)) == [("2024", "000002")]
    assert places(ndjson.summary_targets(spark, root)) == [("2020", "000001")]
    verdicts = {(r.year, r.code): r.reason for r in ndjson.integrity(spark, root).collect()}
    assert verdicts == {("2024", "000001"): None, ("2024", "000002"): None, ("2024", "000003"): "no completion marker", ("2023", "000001"): "meetings without statements: 1", ("2022", "000001"): "meetings line 1", ("2021", "000001"): "no statements file", ("2020", "000001"): None}
    assert [r.content for r in ndjson.statements_of(spark, root, "a", 2024).collect()] == ["y", "x", "z"]
    assert [r.content for r in ndjson.statements_of(spark, root, "q", 2024).collect()] == ["w"]
    assert ndjson.statements_of(spark, root, "none", 2024).count() == 0
    last = clean.last_wins(ndjson.read_summaries(spark, root).select("meetingId", "summary", "line_no"), ["meetingId"], "line_no")
    assert [r.summary for r in last.collect()] == ["2"]
    passing = clean.passing_groups(ndjson.read_meetings(spark, root), "path", clean.meeting_line_valid())
    assert passing.select("year").distinct().count() == 2


def test_writers(spark, tmp_path):
    rows = [("000001", "t", "plenary", datetime.date(2024, 5, 6), None, "e1", [("question", "n", "r", "said", "h", 0, 4)])]
    kind = "array<struct<kind:string,speaker_name:string,speaker_role:string,content:string,content_hash:string,start_offset:int,end_offset:int>>"
    df = spark.createDataFrame(rows, f"municipality_code string, title string, meeting_type string, held_on date, source_url string, external_id string, statements {kind}")
    ndjson.write_scrape(df, str(tmp_path))
    m = spark.read.schema(schemas.MEETING_LINE).json(str(tmp_path / "meetings")).first()
    s = spark.read.schema(schemas.STATEMENT_LINE).json(str(tmp_path / "statements")).first()
    assert (m.id, m.heldOn, m.status) == (s.meetingId, "2024-05-06", "processed") and (tmp_path / "meetings/year=2024/code=000001").exists()
    one = spark.createDataFrame([("a", "000001", "2024-01-01", "s")], "meetingId string, municipalityCode string, heldOn string, summary string")
    ndjson.append_summaries(one, str(tmp_path))
    ndjson.append_summaries(one, str(tmp_path))
    assert spark.read.json(str(tmp_path / "summaries")).count() == 2
    with pytest.raises(Exception, match="no year in heldOn"):
        ndjson.append_summaries(one.withColumn("heldOn", F.lit("??")), str(tmp_path))


def test_master_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text('code,prefecture,name,x,y,url,pop,year\n"011002","北海道","札幌市",,,"https://a","1,9",2020\n011003,北海道,,,,,0,x\n\n')
    got = [tuple(r) for r in ndjson.read_master_csv(spark, str(tmp_path / "m.csv")).collect()]
    assert got[1] == ("011003", "北海道", "北海道", "", None, None) and got[0][:4] == ("011002", "札幌市", "北海道", "https://a") and got[0][4] == 1


def test_page_families(spark):
    one = lambda body, family: [tuple(r) for r in pages.utterances(spark.createDataFrame([(1, body)], "page_id long, body string"), pages.FAMILIES[family]).select("kind", "speaker_role", "speaker_name", "content", "start_offset", "end_offset").orderBy("start_offset").collect()]
    assert one("目次 ○議長（山田君） 開会\nします。○田中市長 はい。●", "kensakusystem") == [("remark", "議長", "山田", "開会 します。", 0, 7), ("answer", "市長", "田中", "はい。", 8, 11)]
    said = json.dumps([{"code": 5, "title": "市長（丁君）", "body": "<pre>市長（丁君） 問い</pre>"}, {"code": 1, "title": "", "body": "目次"}, {"code": 6, "title": "", "body": "答え"}])
    assert one(said, "discussnet_ssp") == [("question", "市長", "丁", "問い", 0, 2), ("answer", None, None, "答え", 3, 5)]


def test_extracted_lines(spark):
    body = "表紙\n－ 1 －\n○議長（山田君） 開会\nします。\f（拍手）\n○市長（田中君） はい。"
    got = pages.lines_to_utterances(spark.createDataFrame([(1, body)], "page_id long, body string")).orderBy("position").collect()
    assert [(r.kind, r.speaker_name, r.content) for r in got] == [("remark", "山田", "開会 します。"), ("answer", "田中", "はい。")]
    df = spark.createDataFrame([("○目次.......1○本文 です○次",), ("なし",)], "b string")
    assert [r[0] for r in df.select(pages.drop_contents_table(F.col("b"))).collect()] == ["○本文 です○次", "なし"]


def test_files_and_links(spark):
    df = spark.createDataFrame([("会議録".encode("cp932"),), (None,)], "content binary")
    assert [r.body for r in pages.decoded(df).collect()] == ["会議録", None]
    assert [r.encoded for r in pages.percent_encoded(spark.createDataFrame([("会",)], "c string"), "c").collect()] == ["%89%EF"]
    rel = pages.absolute_urls(spark.createDataFrame([("http://a/b/c.html", "../d.pdf")], "base string, href string"), "base", "href")
    assert rel.first().url == "http://a/d.pdf"
    import zlib

    pdf = b"%PDF stream\n" + zlib.compress(b"BT (Hello minutes of the meeting) Tj ET") + b"\nendstream"

    def broken(raw):
        raise ValueError

    files = spark.createDataFrame([(pdf,), (b"junk",)], "content binary")
    assert [r.body for r in pages.file_text(files, [broken, lambda b: "x" if b == b"junk" else "", pages.pdf_text_layer]).collect()] == ["Hello minutes of the meeting", "x"]
    html = "<h2>令和6年</h2><a href='a'>3月5日</a><h2>令和5年12月</h2><a href='b'>第1号</a><a href='b'>again</a>"
    links = pages.dated_links(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert [(r.href, r.heading, r.held_on) for r in pages.first_links(links).orderBy("pos").collect()] == [("a", "令和6年", None), ("b", "令和5年12月", "2023-12-01")]


def test_json_trees(spark):
    tree = json.dumps([{"name": "g", "years": [{"year": "2024", "types": [{"name": "t", "councils": [{"council_id": 1, "name": "c"}]}]}, {"year": "2023", "types": []}]}])
    df = spark.createDataFrame([(tree,)], "body string")
    assert [tuple(r) for r in pages.council_tree(df).collect()] == [("g", "2024", "t", 1, "c")] and pages.council_tree(df, year=2023).count() == 0
    s = json.dumps([{"council_id": 1, "schedules": [{"schedule_id": 7, "name": "01月"}, {"schedule_id": 8, "name": "別冊"}]}, {"council_id": 2, "schedules": []}])
    assert [tuple(r) for r in pages.schedules(spark.createDataFrame([(s,)], "body string")).collect()] == [(1, 7, "01月")]


MEETING_ROWS = [
    ("m1", "c1", "定例会", "plenary", datetime.date(2024, 3, 1), None, None, "予算 50% を審議", [("Budget_A", "primary", "about ABC", ["s"]), ("防災", "secondary", "避難", [])]),
    ("m2", "c1", "臨時会", "extraordinary", datetime.date(2024, 3, 1), "u", None, None, [("防災計画", "primary", "budget cuts", [])]),
    ("m3", "c2", "定例会", "plenary", datetime.date(2023, 3, 1), None, None, "none", None),
    ("m4", "c2", "定例会", "plenary", datetime.date(2022, 3, 1), None, None, None, []),
]


@pytest.fixture(scope="module")
def domain(spark):
    rows = [(*r, None, None) for r in MEETING_ROWS]
    towns = [("c1", "札幌市 中央", "北海道", "https://a", 100, 2020), ("c2", "函館市", "北海道", None, None, None), ("c3", "青森市", "青森県", "https://sapporo", 300, 2020)]
    return spark.createDataFrame(rows, schemas.MEETINGS), spark.createDataFrame(towns, schemas.MUNICIPALITIES)


def test_search(domain):
    m, towns = domain
    ids = lambda df, c="meeting_id": [r[c] for r in df.collect()]
    assert ids(search.search_topics(m, "BUDGET")) == ["m2", "m1"] and ids(search.search_topics(m, "予算")) == ["m1", "m1"]
    assert ids(search.search_topics(m, "50%")) == ["m1", "m1"] and ids(search.search_topics(m, "\\%")) == ["m1", "m1"] and ids(search.search_topics(m, "t_A")) == ["m1"]
    assert ids(search.search_topics(m, "防災", limit=1)) == ["m2"] and ids(search.search_topics(m, "防災", code="c2")) == []
    assert ids(search.timeline_topic(m, towns, "防災")) == ["m1", "m2"]
    got = search.timeline_topic(m, towns, "budget").collect()
    assert [[t.topic for t in r.matched_topics] for r in got] == [["Budget_A"], ["防災計画"]]
    both = search.meetings_with_topics(m, ["budget", "防災"], towns).collect()
    assert [(r.meeting_id, r.matched_topics_by_query) for r in both] == [("m2", {"budget": ["防災計画"], "防災": ["防災計画"]}), ("m1", {"budget": ["Budget_A"], "防災": ["防災"]})]
    assert search.meetings_with_topics(m, [], towns).count() == 0 and ids(search.meetings_with_topics(m, ["budget", "ABC"])) == ["m1"]
    assert search.meeting_digest(m, "m3").first().topic_digests == [] and search.meeting_digest(m, "zz").count() == 0
    assert tuple(search.audit_totals(m).first()) == (3, 3)
    assert ids(search.audit_patterns(m, ["防災", "BUDGET"], limit=1)) == ["m2", "m2"]
    with pytest.raises(ValueError):
        search.search_topics(m, "x", limit=101)


def test_lists(domain):
    m, towns = domain
    names = lambda df: [r.code for r in df.collect()]
    assert names(search.list_municipalities(towns, sort_by="population")) == ["c3", "c1", "c2"]
    assert names(search.list_municipalities(towns)) == ["c1", "c2", "c3"]  # in the order of code points
    assert names(search.list_municipalities(towns, query="　北海道　札幌 ")) == ["c1"] and names(search.list_municipalities(towns, query="sapporo")) == ["c3"] and len(names(search.list_municipalities(towns, query="　"))) == 3
    assert {r.base_url for r in search.list_municipalities(towns).collect()} == {None} and search.count_municipalities(towns, codes=["c1", "zz"]).first().total == 1
    rows = search.list_meetings(m, towns, limit=2).collect()
    page, cursor = search.page_of(rows, 2)
    assert [r.id for r in page] == ["m2", "m1"] and cursor == "m1"
    assert [r.id for r in search.list_meetings(m, towns, limit=2, cursor="m1").collect()] == []  # ids alone: later pages are lost
    assert [r.id for r in search.list_meetings(m, towns, limit=2, cursor=("2024-03-01", "m1"), cursor_mode="keyset").collect()] == ["m3", "m4"]
    assert [r.id for r in search.list_meetings(m, towns, municipality="札幌 中央", title="臨時").collect()] == ["m2"] and search.search_tokens("　 ") == []


def test_clusters(spark, domain):
    m, _ = domain
    refs = topics.topic_index(m)
    assert [(r["index"], r.topic) for r in refs.filter("municipality_code = 'c1'").orderBy("index").collect()] == [(0, "Budget_A"), (1, "防災"), (2, "防災計画")]
    members = spark.createDataFrame([("c1", "防災", "d", 0, 1), ("c1", "防災", "d", 0, 2), ("c1", "予算", "", 1, 2), ("c1", "予算", "", 1, 9)], "municipality_code string, canonical_name string, description string, position long, member_index long")
    assert [r["index"] for r in topics.missing(refs, members).collect()] == [0] and [r["index"] for r in topics.assigned_twice(members).collect()] == [2]
    t, links = topics.cluster_rows(refs, members)
    assert {(r.canonical_name, tuple(r.aliases)) for r in t.collect()} == {("防災", ("防災計画",)), ("予算", ("防災計画",))}
    assert {(r.meeting_id, r.canonical_name) for r in links.collect()} == {("m1", "防災"), ("m2", "防災"), ("m2", "予算")}
    assert topics.normalising_clusterer(pd.DataFrame({"index": [0, 1], "topic": ["a x", "b x"], "digest_preview": ["", ""]}))["canonical_name"].tolist() == ["x", "x"]


def test_admission_islands_of_a_hot_key(spark):
    """One key with many events, in bursts and gaps around the window; no collected arrays in the plan."""
    rng = random.Random(4)
    t, rows = 1_700_000_000_000_000, []
    for i in range(4000):
        t += rng.choice([0, 1, 1_000_000, 59_999_999, 60_000_000, 60_000_001, 200_000_000])
        rows.append((i, "hot", t))
    df = spark.createDataFrame(rows, "id long, key string, us long").select("id", "key", F.timestamp_micros("us").alias("ts")).repartition(3)
    found = limits.admission(df, "key", "ts", "id", 60, 2)
    log, want = [], {}
    for i, _, x in rows:
        log = [y for y in log if y > x - 60_000_000]
        want[i] = (len(log) < 2, max(0, 1 - len(log)), None if len(log) < 2 else log[0] + 60_000_000 - x)
        if len(log) < 2:
            log.append(x)
    assert {r.id: (r.admitted, r.remaining, r.retry_us) for r in found.collect()} == want
    assert "collect_list" not in found._jdf.queryExecution().toString()
