"""PDF files, bytes of Shift_JIS pages, and tables of a database that is in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import replies
from quorumlake.sources import database, pages, pdf

FONT = b"begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <01> <4F1A> endbfchar 1 beginbfrange <02> <03> <8B70> endbfrange"


def _file(content: bytes, packed: bool = False) -> bytes:
    """A file of one page; packed: its fonts and pages lie in an object stream, its content is deflated."""
    page = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R /F2 7 0 R >> >> /Contents [4 0 R] >>"
    fonts = {5: b"<< /Type /Font /ToUnicode 6 0 R >>", 7: b"<< /Type /Font /Encoding /90ms-RKSJ-H >>"}
    whole = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: page, **fonts}
    stream = lambda data, more=b"": b"<< /Filter /FlateDecode " + more + b">>\nstream\n" + zlib.compress(data) + b"\nendstream"
    out = b"%PDF-1.5\n"
    if packed:
        head, body = b"", b""
        for number, text in whole.items():
            head += b"%d %d " % (number, len(body))
            body += text + b" "
        out += b"9 0 obj\n" + stream(head + body, b"/Type /ObjStm /N 5 /First %d " % len(head)) + b"\nendobj\n"
    else:
        out += b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in whole.items())
    out += b"4 0 obj\n" + (stream(content) if packed else b"<< >>\nstream\n" + content + b"\nendstream") + b"\nendobj\n"
    return out + b"6 0 obj\n<< >>\nstream\n" + FONT + b"\nendstream\nendobj\n"


@pytest.mark.parametrize("packed", [False, True])
def test_fonts_and_orders(packed):
    content = b"BT /F1 9 Tf 50 700 Td <010203> Tj 0 -20 Td (\\003\\002) Tj ET BT /F2 9 Tf 1 0 0 1 300 700 Tm (" + "右".encode("cp932").replace(b"\\", b"\\\\") + b") Tj ET"
    raw = _file(content, packed)
    assert pdf.text_in_order(raw) == "会議譱\n譱議\n右"
    assert pdf.text_in_layout(raw) == "会議譱  右\n譱議"


def test_strings_of_pdf():
    raw = _file(b"BT 14 TL 0 50 Td (a\\(b\\)(c)\\\nd\\101) ' [(e) -250 <66>] TJ T* (g) Tj ET")
    assert pdf.text_in_order(raw).split("\n") == ["a(b)(c)dAef", "g"]
    assert pdf.text_in_order(b"") == pdf.text_in_layout(b"no pdf") == ""


def test_strategies_in_turn(spark):
    rows = spark.createDataFrame([(1, _file(b"BT /F1 9 Tf 0 0 Td <010203> Tj ET")), (2, b"broken"), (3, None)], "id int, content binary")
    found = pages.file_text(rows, [pdf.text_in_layout, lambda b: "other"], usable=lambda s: pages.is_usable(s, 2))
    assert {r.id: r.body for r in found.collect()} == {1: "会議譱", 2: "other", 3: None}


def test_tree_places_pass_over_second_bytes(spark):
    # 0x81 takes the closing byte with it, as a character's second
    cut = b"data-depth=\"\x81\"ab\" data-depth=\"\" data-depth=\"c"
    old = b"document.viewtree.treedepth.value='\x83\x5c\x27' data-depth=\"x\""
    rows = spark.createDataFrame([(1, cut), (2, old), (3, b""), (4, None), (5, b'data-depth="' + b"\x82\xa0" * 200_000 + b'"')], "id int, raw binary")
    got = {r.id: r.p for r in rows.select("id", pages.tree_places("raw").alias("p")).collect()}
    assert got[1] == ["%81%22%61%62"] and got[2] == ["%83%5C"] and not got[3] and not got[4]
    assert got[5] == ["%82%A0" * 200_000]


# the database in memory takes no null texts from Spark, so that numbers and dates are null here

@pytest.fixture(scope="module")
def url(spark):
    at = "jdbc:derby:memory:minutes;create=true"
    database._execute(spark, at, ['CREATE TABLE meetings ("id" VARCHAR(20) PRIMARY KEY, "code" VARCHAR(6), "external_id" INT, "held_on" DATE, "summary" VARCHAR(99), UNIQUE ("id", "code"))'])
    return at


def test_import_reads_and_updates(spark, url):
    schema = "id string, code string, external_id int, held_on string, summary string, at int"
    keys = [["id"], ["code", "external_id"]]

    def add(rows):
        new = spark.createDataFrame(rows, schema).withColumn("held_on", F.col("held_on").cast("date"))
        return database.insert_ignore_into(new.drop("at"), url, "meetings", keys, ["id", "summary"], batch=2, parts=2)

    first = [("a", "01", 1, "2024-01-01", "one", 1), ("a", "02", 2, "2024-01-02", "two", 2), ("b", "01", 1, "2024-01-03", "three", 3), ("c", "01", None, "2025-01-01", "old", 4), ("d", "01", None, "2026-01-01", "", 5)]
    assert add(first) == 3  # a of 01, c and d: nulls collide with nothing
    assert add(first) == 0
    assert add([("a", "09", 9, "2024-02-01", "taken", 6), ("e", "09", 9, "2024-02-02", "free", 7)]) == 1  # a row that goes blocks none
    held = database.read_table(spark, url, "meetings")
    assert {(r.id, r.summary) for r in held.collect()} == {("a", "one"), ("c", "old"), ("d", ""), ("e", "free")}

    ranges = database.read_table(spark, url, "meetings", ("held_on", "2024-01-01", "2027-01-01", 3))
    assert ranges.rdd.getNumPartitions() == 3 and ranges.count() == 4
    some = ranges.filter("code = '01' and held_on >= date '2025-01-01'").select("id")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(code,01)" in plan and "summary" not in plan
    assert {r.id for r in some.collect()} == {"c", "d"}

    told = spark.createDataFrame([("c", "new"), ("d", "other"), ("z", "no such")], "id string, summary string")
    assert database.update_in(told, url, "meetings", "id", ["summary"], batch=1) == 2
    assert database.update_in(told, url, "meetings", "id", ["summary"]) == 2  # again: the same
    assert {(r.id, r.summary) for r in held.collect()} == {("a", "one"), ("c", "new"), ("d", "other"), ("e", "free")}
    assert add([]) == 0 and held.count() == 4


def test_failed_write_leaves_table_and_no_stage(spark, url):
    long = spark.createDataFrame([("f", "0123456789", None, None, "x")], "id string, code string, external_id int, held_on date, summary string")
    before = database.read_table(spark, url, "meetings").count()
    with pytest.raises(Exception, match="(?i)truncat"):
        database.insert_ignore_into(long, url, "meetings", [["id"]], ["id"])
    assert database.read_table(spark, url, "meetings").count() == before
    assert database.read_table(spark, url, "(SELECT tablename FROM sys.systables WHERE tabletype = 'T') x").count() == 1


def test_gram_vectors_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, "The Minutes"), (2, "the minutes"), (3, ""), (4, None), (5, "ab"), (None, "other words"), (7, "the minute")], "id long, text string")
    found = {r.id: r.embedding for r in replies.gram_vectors(rows, "id", "text", size=64).collect()}
    near = lambda a, b: sum(x * y for x, y in zip(found[a], found[b], strict=True))
    assert len(found) == 7 and all(len(v) == 64 for v in found.values())
    assert found[1] == found[2] and not any(found[3]) and not any(found[4])
    assert abs(near(1, 1) - 1) < 1e-9 and abs(near(None, None) - 1) < 1e-9 and sorted(found[5])[-1] == 1
    assert near(1, 7) > 0.9 > near(1, None)
    # over several blocks: as a count of all runs says, line ends and long texts included
    long = "".join(chr(97 + i * i % 23) + "\n" * (i % 50 == 0) for i in range(3000))
    texts = {i: long[:i] for i in (1, 2, 3, 127, 128, 129, 130, 131, 256, 257, 3000)}
    found = replies.gram_vectors(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text", size=32)
    for r in found.collect():
        counts = [0] * 32
        for i in range(max(1, r.id - 2)):
            counts[int(hashlib.md5(texts[r.id][i : i + 3].encode()).hexdigest()[:8], 16) % 32] += 1
        assert r.embedding == pytest.approx([c / sum(x * x for x in counts) ** 0.5 for c in counts])
