"""What the steps of larger tables move: plans and layouts that grow no faster than their input."""

import contextlib
import io

import pandas as pd
from pyspark.sql import functions as F

from quorumlake.operators import topics
from quorumlake.plans import fixtures
from quorumlake.sources import ndjson

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain("simple")
    return said.getvalue()


def test_a_clusterer_of_many_takes_many_municipalities_in_a_call(spark):
    rows = [(f"m{i % 500}" if i % 500 else None, i // 500, f"x {'cab'[(i * 7 + i // 500) % 3]}", "") for i in range(2000)]
    refs = spark.createDataFrame(rows, "municipality_code string, index long, topic string, digest_preview string").repartition(3)
    calls = spark.sparkContext.accumulator(0)

    @topics.of_many
    def counted(pdf):
        calls.add(1)
        return topics.normalising_clusterer(pdf)

    got = {tuple(r) for r in topics.cluster_with(refs, counted).collect()}
    assert calls.value <= 3
    one_by_one = lambda pdf: topics.normalising_clusterer(pdf).drop(columns="group")
    assert got == {tuple(r) for r in topics.cluster_with(refs, one_by_one).collect()}
    pdf, want = pd.DataFrame(rows, columns=["m", "index", "topic", "p"]), set()
    for m in {r[0] for r in rows}:
        own = pdf[pdf["m"].isna()] if m is None else pdf[pdf["m"] == m]
        names = own["topic"].str[-1]
        want |= {(m, n, "", sorted(set(names)).index(n), i) for n, i in zip(names, own["index"], strict=True)}
    assert got == want


def test_the_searches_table_is_gathered_once(spark):
    """Lines are shuffled by meeting alone, not by date, and not gathered before that."""
    said = plan(fixtures.nested(spark, DATA).sortWithinPartitions("held_on", "id"))
    assert "rangepartitioning" not in said
    gathers = [i for i, x in enumerate(said.split("\n")) if "partial_collect_list" in x]
    deals = [i for i, x in enumerate(said.split("\n")) if "hashpartitioning(meeting_id" in x]
    assert gathers and deals and gathers[0] < deals[0]


def test_lines_are_made_after_the_sort(spark, tmp_path):
    """The write adds no sort of its own, which would sort whole lines and could part equal folders' order."""
    rows = spark.range(3000).select(F.lit("2024").alias("year"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("code"), (-F.col("id")).alias("place"))
    ndjson.land(rows, str(tmp_path), ndjson.MEETINGS, F.to_json(F.struct("place")))
    got = [x for x in (tmp_path / "2024/c1" / ndjson.MEETINGS).read_text().split("\n") if x]
    assert got == [f'{{"place":{-i}}}' for i in range(2998, -1, -3)]


def test_small_tables_are_dealt_to_many_tasks(spark):
    """A table of one small file must not make one task of what costs much for each row."""
    from quorumlake.plans import rules

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("pdf_layouts", "merged_pages", "file_texts"):
            assert rules.QUERIES[name](spark, DATA).rdd.getNumPartitions() >= 3, name
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_blocks_of_an_index_are_bounded():
    assert fixtures.blocks_of(499) == 1 and fixtures.blocks_of(5000) == 11 and fixtures.blocks_of(60_000_000) == fixtures.MAX_BLOCKS


def test_runs_of_long_texts_are_whole(monkeypatch):
    from quorumlake.operators import grams

    monkeypatch.setattr(grams, "CHARS", 5)
    texts = ["", "ab", "abc", "a𠮷bc" * 9, "ÿ" * 4]
    for n in (1, 3, 5):
        got = sorted((int(o), joined[i : i + n]) for joined, owner, at, _ in grams.runs(texts, n) for o, i in zip(owner, at.tolist(), strict=True))
        assert got == sorted((k, t[i : i + n]) for k, t in enumerate(texts) for i in range(len(t) - n + 1))


def test_vectors_shuffle_nothing(spark):
    from quorumlake.operators import replies

    df = spark.createDataFrame([(1, "abcab"), (2, None), (3, "é")], "id long, text string")
    found = replies.gram_vectors(df, "id", "text", size=16)
    assert "Exchange" not in plan(found)
    got = {r.id: r.embedding for r in found.collect()}
    assert len(got[1]) == 16 and abs(sum(x * x for x in got[1]) - 1) < 1e-12 and not any(got[2]) and sum(got[3]) == 1


def test_patterns_meet_by_day(spark):
    """Ranks run on over days, ties of the limit's day are cut in order, and no task gets all hits of a pattern."""
    from quorumlake.plans import search

    days = ["2024-01-03", "2024-01-03", "2024-01-02", "2024-01-01", None, "2024-01-02"]
    rows = [(f"m{i}", d, [("tax a", "x", "d", []), ("tax b", "x", "d", [])]) for i, d in enumerate(days)]
    m = spark.createDataFrame(rows, "id string, held_on string, topic_digests array<struct<topic:string,relevance:string,digest:string,speakers:array<string>>>").withColumn("held_on", F.col("held_on").cast("date"))
    for limit in (1, 3, 7, 11, 50):
        found = search.audit_patterns(m, ["TAX"], limit=limit)
        got = [(r.n, r.meeting_id, r.topic) for r in sorted(found.collect(), key=lambda r: r.n)]
        want = [(f"m{i}", f"tax {x}") for i in (1, 0, 5, 2, 3, 4) for x in "ab"]
        assert got == [(k + 1, *x) for k, x in enumerate(want[:limit])]
    assert "Window [(before" not in plan(found) and not [x for x in plan(found).split("\n") if "Window [row_number" in x and "held_on" not in x.split("],")[-2]]


def test_whole_texts_come_in_small_batches(spark):
    from quorumlake.sources import pages

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pages.decoded(spark.createDataFrame([(bytearray(b"a"),)], "content binary"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_meetings_not_digests_are_sorted_for_the_index(spark):
    """F10 F12 F13 F20: the sort holds a row for each meeting, the members come of one pass, and a repeated id is numbered by place first."""
    from quorumlake.plans import catalogue

    said = plan(catalogue.QUERIES["cluster_dupes"](spark, DATA))
    assert said.count("Exchange") == 1 and said.count("Window [") >= 1 and "Union" not in said
    assert said.index("Generate") < said.index("Window [")  # above the window, which is below it in the plan
    rows = [("m", "x", "b", 3), ("m", "x", "b", 1), ("m", "x", "a", 2), ("m", "x", "c", 0), ("n", None, "a", 1), ("m", None, "z", 1), (None, "x", "a", 2), ("m", "x", "b", 2), ("n", "x", "q", None)]
    schema = "municipality_code string, held_on string, id string, topic_digests array<struct<topic:string,relevance:string,digest:string>>"
    made = [(m, d, i, None if n is None else [(f"{i}{k}", None, "d" * 200) for k in range(n)]) for m, d, i, n in rows]
    got = sorted((str(r.municipality_code), r["index"], r.meeting_id, r.topic, len(r.digest_preview)) for r in topics.topic_index(spark.createDataFrame(made, schema).repartition(3)).collect())
    want = []
    for m in {r[0] for r in rows}:
        own = sorted((d or "", i, k) for c, d, i, n in rows if c == m for k in range(n or 0))
        want += [(str(m), at, i, f"{i}{k}", topics.PREVIEW) for at, (_, i, k) in enumerate(own)]
    assert got == sorted(want)
