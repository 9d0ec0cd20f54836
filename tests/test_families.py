"""Page families in the services' own markup, trees and frames of landed pages, and the table functions."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quorumlake.functions import tables, text
from quorumlake.sources import markup, pages, services


def said(found):
    return [(r.kind, r.speaker_role, r.speaker_name, r.content, r.start_offset, r.end_offset) for r in found.orderBy("start_offset").collect()]


def one(spark, body, family):
    return said(pages.utterances(spark.createDataFrame([(1, body)], "page_id long, body string"), pages.FAMILIES[family]))


OPENING = [("remark", "議長", "林一郎", "会議を始めます。", 0, 8), ("question", "議員", "森花子", "お尋ねします。", 9, 16)]


def test_voice_blocks(spark):
    html = """<ul id="page-list"><li class="voice-block" data-voice-title="◯議長（林一郎）">
      <ul><li>1</li></ul><p class="voice__text">会議を始めます。</p></li>
      <li class="voice-block" data-voice-title="◯議員（森花子）"><p class="voice__text">お尋ねします。</p><p class="voice__text">二つ目</p></li>
      <li class="voice-block" data-voice-title="◯議長（林一郎）"><p class="voice__text"></p></li></ul>"""
    assert one(spark, html, "dbsearch") == OPENING


def test_titles_in_headers(spark):
    item = """<li><div class="row voice__header hidden-print" role="button"><div class="col-md-9"><div class="voice__name">
      <span class="voice__number">{n}: </span><span class="voice__title">◯{who}</span></div></div><div><p class="voice__hits">検索語: なし</p></div></div>
      <div class="voice__textwrap"><div class="row voice__text voice__text--print"><div class="col-md-12"><p class="js-textwrap-container">
      <span class="visible-print-block">{n}: </span>◯{who}{text}</p></div></div></div></li>"""
    html = "<ul class='voice__list'>" + item.format(n=1, who="議長（林一郎）", text="会議を始めます。") + item.format(n=2, who="議員（森花子）", text="お尋ねします。") + "</ul>"
    assert one(spark, html, "dbsearch") == OPENING


def test_page_texts(spark):
    item = """<{tag} class="page-text__voice" id="VoiceNo{n}"><p class="page-text__text textwrap">
      <span class="page-text__number VoiceAnchor" data-voiceno="{n}">{n}</span>
      ◯{who}　{text}<br />
      </p></{tag}>"""
    for tag in ("div", "li"):
        html = "<div class=page-text>" + item.format(tag=tag, n=1, who="議長（林一郎君）", text="会議を始めます。") + item.format(tag=tag, n=2, who="議員（森花子）", text="お尋ねします。") + "</div>"
        assert one(spark, html, "dbsearch") == OPENING


def test_first_layout_with_text_holds(spark):
    old = '<li class="voice_block" data-voice-title="◯議長（林）"><p class="voice__text">{}</p></li>'
    new = '<p class="page-text__text">◯市長（森）　答えます。</p>'
    assert [x[3] for x in one(spark, old.format("古い") + new, "dbsearch")] == ["古い"]
    assert one(spark, old.format(" ") + new, "dbsearch") == [("answer", "市長", "森", "答えます。", 0, 5)]
    assert one(spark, "<p class='other'>◯市長（森）　答えます。</p>", "dbsearch") == [] and one(spark, None, "dbsearch") == []


def test_events(spark):
    html = "<div><div class='a'>x<br>y</div><p>open<p>again</p></div><script>if (a<b) c</script><!-- <p> --></b>"
    got = markup.events(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("pos").collect()
    assert [(r.token, r.kind, r.end) for r in got] == [
        ("<div>", "open", 11), ("<div class='a'>", "open", 5), ("x", "text", None), ("<br>", "single", None), ("y", "text", None), ("</div>", "close", None), ("<p>", "open", markup.PAGE_END),
        ("open", "text", None), ("<p>", "open", 10), ("again", "text", None), ("</p>", "close", None), ("</div>", "close", None), ("<!-- <p> -->", "note", None), ("</b>", "close", None),
    ]
    attributes = spark.createDataFrame([("<p class='a b' data-x=1 id=\"c\">",)], "t string").select(*[markup.attribute("t", x).alias(x.replace("-", "_")) for x in ("class", "data-x", "id", "none")]).first()
    assert tuple(attributes) == ("a b", "1", "c", "")


def test_anchors_on_a_page(spark):
    html = """<BODY><A NAME="HUID100"></A>令和　６年定例会<BR><BR>出席議員<BR>
      <A NAME="HUID101"></A>◎議会局長（川誠君）　おはようございます。<BR>
      <A NAME="HUID102"></A>○議長（酒泉君）　始めます。<BR><A NAME="HUID103"></A>△開会の宣告<BR>
      <A NAME="HUID104"></A>○17番（山真弓君）　質問です。<BR><A NAME="HUID105"></A>◆川田青　分科会委員　　二つあります。<P>続き<BR><A NAME="HUID106"></A>○議長（酒泉君）<BR></BODY>"""
    assert one(spark, html, "gijiroku_com") == [
        ("answer", "議会局長", "川誠", "おはようございます。", 0, 10), ("remark", "議長", "酒泉", "始めます。", 11, 16),
        ("question", "17番", "山真弓", "質問です。", 17, 22), ("question", "分科会委員", "川田青", "二つあります。\n続き", 23, 33),
    ]


def test_sidebar_and_its_pages(spark):
    entry = '<TR><A NAME="{}"></A><IMG><B>{}</B></TR>'
    side = "".join(entry.format(*x) for x in [("1", "(名簿)"), ("12", "◎局長"), ("11", "○議長"), ("13", "△散会"), ("14", "landed nowhere"), ("15", "no utterance")])
    page = '<A NAME="x"></A>前の頁<A NAME="HUID{0}"></A>{1}<BR><FORM>◎誰（か）　form</FORM>'
    landed = [("m", "12", page.format(12, "◎局長（川君）　おはよう。")), ("m", "11", page.format(11, "○議長（酒君）　始めます。")), ("m", "11", page.format(11, "○議長（酒君）　始めます。")), ("m", "1", page.format(1, "○名簿（君）　x")), ("m", "15", "nothing"), ("other", "12", page.format(12, "○議員（他君）　x"))]
    found = services.gijiroku_utterances(spark.createDataFrame([("m", side)], "meeting string, html string"), spark.createDataFrame(landed, "meeting string, huid string, html string"))
    assert [(r.meeting, r.position) for r in found.orderBy("position").collect()] == [("m", 1), ("m", 2)]
    assert said(found) == [("answer", "局長", "川", "おはよう。", 0, 5), ("remark", "議長", "酒", "始めます。", 6, 11)]


def tab(x):
    return f"<A HREF=\"javascript:document.viewtree.submit()\"onClick=\"document.viewtree.treedepth.value='{x}'\">t</A>"


def link(file):
    return f'<A HREF="/x/cgi-bin3/ResultFrame.exe?Code=c&amp;fileName={file}&amp;n=1">r</A>'


def test_tree_of_three_levels(spark):
    top = tab("令和 7年") + tab("令和元年") + tab("令和 7年")
    rows = [
        ("s", None, top), ("s", "令和 7年", top + link("R070110A") + tab("本会議") + tab("委員会")), ("s", "本会議", top + tab("本会議") + link("R070214A") + link("R070110A") + tab("never opened")),
        ("s", "委員会", top + tab("本会議") + tab("委員会") + tab("総務") + tab("総務")), ("s", "総務", link("H300301A") + link("junk")), ("s", "never opened", link("R060606A")),
        ("s", "令和元年", top + tab("本会議")), ("t", None, tab("平成27年")), ("t", "平成27年", link("H270505A")), ("t", "本会議", link("H271111A")),
    ]
    df = spark.createDataFrame(rows, "site string, node string, html string")
    got = sorted((r.site, r.title, r.held_on, r.file) for r in services.tree_meetings(df).collect())
    assert got == [("s", "2025-01-10", "2025-01-10", "R070110A"), ("s", "本会議 2025-02-14", "2025-02-14", "R070214A"), ("s", "総務 2018-03-01", "2018-03-01", "H300301A"), ("t", "2015-05-05", "2015-05-05", "H270505A")]
    assert {r.file for r in services.tree_meetings(df, 2026).collect()} == {"R070110A", "R070214A", "H300301A"} and {r.file for r in services.tree_meetings(df, 2015).collect()} == {"R070110A", "R070214A", "H270505A"}


def test_speakers_frames(spark):
    frames = spark.createDataFrame([("<FRAMESET><FRAME NAME='x' SRC=\"r_Speakers.exe?a/b\"></FRAMESET>",), ("<p>",)], "html string")
    assert [r[0] for r in frames.select(services.speakers_frame(F.col("html"))).collect()] == ["r_Speakers.exe?a/b", None]
    links = "".join(f'<A HREF="/x/r_TextFrame.exe?code/R07A/{p}/0//10">t</A>' for p in (0, 226, 9))
    form = '<FORM action="GetPerson.exe" name="download"><input type="hidden" name="Code" value="c"><input value="f" name="fileName"><input type="checkbox" name="downloadPos" value="5" ><input type="checkbox" name="downloadPos" value="7" ></FORM>'
    lists = spark.createDataFrame([("a", links), ("b", form + links), ("c", "")], "meeting string, html string")
    turns = services.speaker_positions(lists)
    assert sorted((r.meeting, r.place, r.code, r.file, r.position) for r in turns.collect()) == [("a", 0, "code", "R07A", "226"), ("a", 1, "code", "R07A", "9"), ("b", 0, "c", "f", "5"), ("b", 1, "c", "f", "7")]
    texts = spark.createDataFrame([("code", "R07A", "9", "○市長（森君） はい。"), ("code", "R07A", "226", "○議長（林君） では。"), ("code", "R07A", "0", "○議事日程")], "code string, file string, position string, body string")
    body = services.assembled_texts(turns, texts).withColumnRenamed("meeting", "page_id")
    assert said(pages.utterances(body, pages.FAMILIES["kensakusystem"])) == [("remark", "議長", "林", "では。", 0, 3), ("answer", "市長", "森", "はい。", 4, 7)]


def test_dates_behind_links(spark):
    html = "<a href='a'>第<b>1</b>号</a><div class=date>開催日：2025年1月9日</div><a href='b'>2</a><span>x 2024-12-24</span> 2023年1月1日<a href=c>3</a>" + "x" * 296 + "2022-02-02"
    got = services.links_with_dates(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).collect()
    assert [(r.pos, r.href, r.label, r.held_on) for r in got] == [(0, "a", "第1号", "2024-12-24"), (1, "b", "2", "2024-12-24")]
    near = services.links_with_dates(spark.createDataFrame([(1, "<a href='a'>1</a><p>2025年1月9日</p>")], "page_id int, html string"))
    assert near.first().held_on == "2025-01-09"


def test_tenant_numbers(spark):
    scripts = ["dnp.params.tenant_id = 89", "// <input name=\"tenant_id\" value=\"1\">\ndocument.write('<input name=\"tenant_id\" value=\"396\">');", "none", None]
    df = spark.createDataFrame([(x,) for x in scripts], "s string")
    assert [r[0] for r in df.select(text.tenant_id("s")).collect()] == [89, 396, None, None]


def test_table_functions(spark):
    tables.register(spark)
    pieces = spark.createDataFrame([("b", 2, "○議長（林君）　では。<BR>"), ("a", 1, "◆川田青　委員　　はい。"), ("b", 1, "△開会"), ("b", 3, "◎市長　答えます。"), ("b", 4, None)], "meeting string, place int, piece string")
    got = spark.sql("SELECT * FROM family_utterances(TABLE(SELECT meeting, place, piece FROM {p}), 'gijiroku_com')", p=pieces).collect()
    assert sorted(tuple(r) for r in got) == [("a", 0, 1, "◆", "委員", "川田青", "はい。", 0, 3), ("b", 0, 2, "○", "議長", "林", "では。", 0, 3), ("b", 1, 3, "◎", "市長", None, "答えます。", 4, 9)]
    with pytest.raises(AnalysisException, match="no page family 'x'"):
        spark.sql("SELECT * FROM family_utterances(TABLE(SELECT meeting, place, piece FROM {p}), 'x')", p=pieces)
    web = spark.createDataFrame([(1, "http://h/a/", "<h2>令和&amp;6年 <b>x</b></h2><a href='b.html'>第 1\n号</a><a name=n>no</a><a href=c>2</a>"), (2, None, None)], "page_id int, url string, html string")
    got = spark.sql("SELECT page_id, l.* FROM {w}, LATERAL page_links(html, url) l", w=web).collect()
    assert [tuple(r) for r in got] == [(1, 0, "http://h/a/b.html", "第 1 号", "令和&6年 x"), (1, 1, "http://h/a/c", "2", "令和&6年 x")]
