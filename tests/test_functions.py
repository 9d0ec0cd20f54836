import datetime

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import classify, dates, speakers, text


def ask(spark, values, *exprs, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    out = [tuple(r) for r in df.select(*[e.alias(f"e{i}") for i, e in enumerate(exprs)]).collect()]
    return [r[0] for r in out] if len(exprs) == 1 else out


C = "c"


def test_space_includes_ideographic(spark):
    assert ask(spark, ["　 a　b \n", "", "　"], text.trim_all(C)) == ["a　b", "", ""]
    assert ask(spark, ["　a　 b c "], text.squeeze(C)) == ["a b c"]
    assert ask(spark, [" a　b ", "　", ""], text.tokens(C)) == [["a", "b"], [], []]


def test_digits_and_cjk(spark):
    assert ask(spark, ["１２月９日"], text.half_width_digits(C)) == ["12月9日"]
    assert ask(spark, ["会 議 録 の A B"], text.despace_cjk(C)) == ["会議録の A B"]
    assert ask(spark, ["◯１　〇"], text.normalise(C)) == ["○1 ○"]


def test_markup(spark):
    html = "<p>a<br>b&nbsp;&amp;lt;</p>\n\n\n\n<b>c</b>"
    assert ask(spark, [html], text.html_to_text(C)) == ["a\nb &lt;\n\nc"]
    assert ask(spark, ["<script>x<y</script>t<style>\np</style>&lt;"], text.strip_html(C)) == ["t<"]
    found = ask(spark, ['<a class="x" href="a.html"> A <b>1</b></a><A HREF=\'b\'>B</A>'], text.anchors(C))[0]
    assert [tuple(x) for x in found] == [("a.html", "A 1"), ("b", "B")]


def test_lookback_and_split(spark):
    assert ask(spark, ["abcdefXg", "Xa", "none"], text.text_before(C, "X", 3)) == ["def", "", None]
    assert ask(spark, ["序○甲◎乙"], text.split_before(C)) == [["序", "○甲", "◎乙"]]


def test_pdf_lines(spark):
    assert ask(spark, ["甲 乙\f１２\r\nx  y\n\n\n\nz"], text.pdf_lines(C)) == ["甲乙\n12\nx y\n\nz"]
    assert ask(spark, ["", "－ 12 －", "○", "（拍手）", "本文（拍手）"], text.is_noise_line(C)) == [True, True, True, True, False]


def test_ids(spark):
    df = spark.createDataFrame([("h", "1"), ("h", None), ("h", "")], "a string, b string")
    assert [r[0] for r in df.select(text.composite_id("s", "a", "b")).collect()] == ["s_h_1", None, None]


def test_hosts(spark):
    df = spark.createDataFrame([("bad url", "https://Foo.dbsr.jp/x"), (None, "nope"), ("http://a.b.kensakusystem.jp/", None), ("https://city.example.lg.jp/", None)], "a string, b string")
    assert [tuple(r) for r in df.select(text.host("a", "b").alias("h")).select("h", text.group_key("h")).collect()] == [("foo.dbsr.jp", "dbsr.jp"), ("unknown", "unknown"), ("a.b.kensakusystem.jp", "kensakusystem.jp"), ("city.example.lg.jp", "city.example.lg.jp")]


def test_routing_takes_the_first_rule(spark):
    urls = ["https://ssp.kaigiroku.net/tenant/a/", "https://own.jp/tenant/b/x?dbsr.jp", "https://x.dbsr.jp/", "http://kensakusystem.jp/a/", "http://kensakusystem.jp/a-vod/", "http://x.gijiroku.com/", "http://c.jp/voices/g08v_search.asp", "http://c.jp/"]
    assert ask(spark, urls, text.adapter_key(C, F.lit("462225"))) == ["discussnet_ssp", "discussnet_ssp", "dbsearch", "kensakusystem", "462225", "gijiroku_com", "gijiroku_com", "462225"]


def test_retry_delay(spark):
    assert ask(spark, ['{"retryDelay": "23.6341s"}', "Please retry in 682.756ms.", "Please retry in 2.5s", "no"], text.retry_delay_ms(C)) == [23635, 683, 2500, None]


def test_like_pattern(spark):
    assert text.like_pattern("a\\b%\\%\\\\") == "%ab%\\%\\\\%"
    assert ask(spark, ["xab%y"], F.col(C).like(text.like_pattern("a\\b\\%"))) == [True]


def test_jsonp(spark):
    assert ask(spark, ["cb.x({\"a\": 1});", "[1]"], text.jsonp_body(C)) == ['{"a": 1}', "[1]"]


def test_utf16_length(spark):
    assert ask(spark, ["𠮷野", "abc"], text.length_utf16(C)) == [3, 3]


def test_kanji_numbers(spark):
    assert ask(spark, ["一", "十", "十九", "二十", "三十一", "九十九", "〇", ""], dates.kanji_number(C)) == [1, 10, 19, 20, 31, 99, 0, 0]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("令和6年3月15日 出席", "2024-03-15"), ("平成３１年４月１日", "2019-04-01"), ("昭和 63年 1月 2日", "1988-01-02"), ("2023年(令和5年)2月3日", "2023-02-03"),
        ("令和5年（2022年）12月1日", "2022-12-01"), ("令和七年二月十九日", "2025-02-19"), ("令和6年\n第1回\n3月5日", "2024-03-05"), ("令和6年 会議 三月二十日", "2024-03-20"),
        ("2024.5.6", "2024-05-06"), ("<td>2024/11/30</td>", "2024-11-30"), ("なし", None),
    ],
)
def test_sitting_dates(spark, given, want):
    assert ask(spark, [given], dates.sitting_date(C)) == [want]


def test_other_dates(spark):
    assert ask(spark, ["令和元年5月7日", "平成30年12月31日", "2020-1-2", "x"], dates.era_date(C)) == ["2019-05-07", "2018-12-31", "2020-01-02", None]
    assert ask(spark, ["R080106B02", "h300000x", "S631231", "X010101", "aR080106"], dates.filename_date(C)) == ["2026-01-06", "2018-01-01", "1988-12-31", None, None]
    assert ask(spark, ["２月27日－01号", "27日"], dates.month_day_date(C, F.lit("2025"))) == ["2025-02-27", None]
    assert ask(spark, ["令和3年6月", "2020年7月号", "令和3年6月9日", ""], dates.estimated_date(C)) == ["2021-06-01", "2020-07-01", "2021-06-09", None]
    assert ask(spark, ["令和 7 年", "平成元年", "2001 年", "年"], dates.label_year(C)) == [2025, 1989, 2001, None]
    assert ask(spark, ["令和7年", "令和3年", "年"], dates.within_years(C, 2024)) == [True, False, True]
    assert ask(spark, ["2024-02-30", "2024-13-01", "2024-02-29"], dates.valid_date(C)) == [None, None, datetime.date(2024, 2, 29)]
    assert ask(spark, [2018, 2019, 2024], dates.era_labels(C), kind="int") == [["平成30年"], ["令和元年", "令和1年", "平成31年"], ["令和6年"]]


def test_roles(spark):
    roles = ["副市長", "総務部長", "議長", "副議長", "予算委員長", "副委員長", "山田議員", "環境委員", "３番", "調査員", "", None]
    assert ask(spark, roles, classify.utterance_kind(C)) == ["answer", "answer", "remark", "remark", "remark", "remark", "question", "question", "question", "remark", "remark", "remark"]
    assert ask(spark, ["センター長", "環境センター長", "委員長", "議員", "調査員", None], classify.utterance_kind_tree(C)) == ["answer", "answer", "remark", "question", "question", "remark"]
    assert ask(spark, [4, 5, 6, 7, None], classify.kind_by_code(C), kind="int") == ["remark", "question", "answer", None, None]
    assert ask(spark, ["予算副委員長", "財政課長", "なし"], classify.role_suffix(C)) == ["委員長", "課長", None]


def test_noise(spark):
    said = ["○議長", "△日程", "◆理解しました。", "◎" + "あ" * 30 + "～説明員紹介～", "◎" + "あ" * 60 + "～説明員紹介～", "◆" + "あ" * 25, "はい", "　はい　　", "ありがとう", "副 町 長 山 下", "山 下", "副 町長 山"]
    assert ask(spark, said, classify.is_noise(C)) == [True, True, True, True, False, False, True, True, False, True, True, False]


def test_agents_and_domains(spark):
    assert ask(spark, ["Mozilla/5.0", "python-requests/2", None, "", "CURL/8"], classify.is_blocked_agent(C)) == [False, True, True, True, True]
    assert ask(spark, ["a@City.Example.lg.jp", "a@lg.jp", "b@gmail.com", "b@evilgmail.com", "none", None], classify.is_allowed_domain(C, ["gmail.com", "*.lg.jp"])) == [True, False, True, False, False, None]


def test_speaker_headers(spark):
    t = lambda f, v: tuple(ask(spark, [v], f(C))[0])
    assert t(speakers.voice_title, "◯議長（高瀬博文君）") == ("議長", "高瀬博文") and t(speakers.voice_title, "◯議長") == ("議長", None) and t(speakers.voice_title, "") == (None, None)
    assert t(speakers.schedule_title, "市長（山田太郎君）") == ("市長", "山田太郎") and t(speakers.schedule_title, "（山田議員）") == (None, "山田") and t(speakers.schedule_title, "山田") == (None, None)
    assert t(speakers.marked_header, "◎議会局長（川崎 誠君）") == ("議会局長", "川崎誠", "◎") and t(speakers.marked_header, "◎中山　都市計画課長") == ("都市計画課長", "中山", "◎") and t(speakers.marked_header, "x") == (None, None, None)
    assert t(speakers.utterance, "○議長（川越桂路君） 開会します。") == ("議長", "川越桂路", "開会します。")
    assert t(speakers.utterance, "○１２番（宮崎栄樹君） 質問") == ("議員", "宮崎栄樹", "質問")
    assert t(speakers.utterance, "○青山支所長（兼地域振興総括監）（稲森真一君） はい") [1:] == ("稲森真一", "はい")
    assert t(speakers.utterance, "○田中市長 答えます") == ("市長", "田中", "答えます")
    assert t(speakers.utterance, "○山本 質問です") == (None, "山本", "質問です") and t(speakers.utterance, "本文 だけ") == (None, None, "本文 だけ")
    assert t(speakers.seat_header, "３．議長（山田君）") == (3, "議長", "山田")
