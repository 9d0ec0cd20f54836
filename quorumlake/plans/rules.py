"""Queries of functions and small operators: each over its whole tables, with its meaning in SQL beside it."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classify, dates, shape, speakers, tables, text
from ..operators import replies, runs
from ..sources import pages, pdf, services
from . import fixtures as fx
from . import search

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


_BLANK = "[\\s\\x0B\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
_NAMED = "replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _untag(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', '', 'g')"


_HTML_TEXT = _trim("regexp_replace(" + _NAMED.format(_untag("regexp_replace(html, '(?i)<br\\s*/?>|</p\\s*>', chr(10), 'g')")) + ", '\\n{3,}', chr(10) || chr(10), 'g')")


def _choose(key: str, *values: str):
    """One of values by a number of the row: a made header for each row."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _chosen(key: str, *values: str | None) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][({key} % {len(values)} + 1)::int]"


# texts

@query(f"SELECT page_id, sha256({_HTML_TEXT}) AS text_hash FROM pages")
def html_text(spark, d):
    return fx.table(spark, d, "pages").select("page_id", F.sha2(text.html_to_text("html"), 256).alias("text_hash"))


ORACLE["page_lines"] = f"SELECT page_id, sha256({_trim(_untag('html'))}) AS text_hash FROM pages"


@query(f"""SELECT doc_id, sha256({_trim("chr(12288) || ' ' || text || chr(160) || chr(10)")}) AS hash FROM documents""")
def trimmed(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.sha2(text.trim_all(F.concat(F.lit("\u3000 "), "text", F.lit("\u00a0\n"))), 256).alias("hash"))


@query("SELECT doc_id, translate(doc_id::varchar, '0123456789', '零一二三四五六七八九') || '議会 a b　会議' AS said FROM documents")
def despaced(spark, d):
    spaced = F.regexp_replace(F.translate(F.col("doc_id").cast("string"), "0123456789", "零一二三四五六七八九"), "(.)", "$1 ")
    return fx.table(spark, d, "documents").select("doc_id", text.despace_cjk(F.concat(spaced, F.lit("　議 会 a b　会  議"))).alias("said"))


_PDF_LINES = "regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\\f|\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ')), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')"
_NOISE = "x = '' OR regexp_matches(x, '^[―─－−\\-\\s]*[0-9]+[\\s―─－−\\-]*$') OR regexp_matches(x, '^[―─－−\\- ]*[○◯◎●][―─－−\\- ]*$') OR regexp_matches(x, '^[（(].*?(呼ぶ者あり|起立者あり|拍手|休憩|登壇|退席|着席).*?[）)]$')"


@query(f"WITH l AS (SELECT doc_id, {_PDF_LINES} AS t FROM documents) SELECT doc_id, sha256(t) AS hash, len(list_filter(string_split(t, chr(10)), lambda x: {_NOISE}))::int AS noise FROM l")
def extracted_lines(spark, d):
    rows = fx.table(spark, d, "documents").select("doc_id", text.pdf_lines("text").alias("t"))
    return rows.select("doc_id", F.sha2("t", 256).alias("hash"), F.size(F.filter(F.split("t", "\n"), lambda x: text.is_noise_line(x))).alias("noise"))


_LINES = ("－ 12 －", "○", "（拍手）", "（「異議なし」と呼ぶ者あり）", "第１号", "12番", "（ただし書き）")


@query(f"WITH r AS (SELECT doc_id, {_chosen('doc_id', *_LINES)} AS x FROM documents) SELECT doc_id, {_NOISE} AS noise FROM r")
def noise_lines(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", text.is_noise_line(_choose("doc_id", *_LINES)).alias("noise"))


@query("SELECT page_id, url_encode(url) AS encoded FROM pages")
def percent_encoded(spark, d):
    return pages.percent_encoded(fx.table(spark, d, "pages"), "url", "utf-8").select("page_id", "encoded")


@query("WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>', 1)) AS href FROM pages) SELECT page_id, href, regexp_extract(url, '^[a-z]+://[^/]+') || href AS url FROM h")
def absolute_urls(spark, d):
    links = fx.table(spark, d, "pages").select("page_id", F.col("url").alias("base"), F.explode(text.anchors("html")).alias("a")).select("page_id", "base", "a.href")
    return pages.absolute_urls(links, "base", "href").select("page_id", "href", "url")


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS label FROM events")
def timestamp_labels(spark, d):
    return fx.table(spark, d, "events").select("event_id", text.timestamp_label("ts").alias("label"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN ceil(value::decimal(12,2) * 1000) WHEN 'view' THEN ceil(value::decimal(12,2)) WHEN 'error' THEN ceil(value::decimal(12,2) * 1000) END::bigint AS delay_ms, event_type IN ('error', 'purchase') AS again FROM events")
def retry_delays(spark, d):
    v = F.col("value").cast("decimal(12,2)").cast("string")
    said = F.when(F.col("event_type") == "click", F.concat(F.lit("Please retry in "), v, F.lit("s"))).when(F.col("event_type") == "view", F.concat(F.lit("Please retry in "), v, F.lit("ms")))
    said = said.when(F.col("event_type") == "error", F.concat(F.lit('503 {"retryDelay": "'), v, F.lit('s"}'))).when(F.col("event_type") == "purchase", "the call timed out").otherwise("no such model")
    return fx.table(spark, d, "events").select("event_id", text.retry_delay_ms(said).alias("delay_ms"), replies.is_retryable(said).alias("again"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'no call' ELSE props END AS body FROM events")
def jsonp(spark, d):
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("cb.x("), "props", F.lit(");\n"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("no call")
    return fx.table(spark, d, "events").select("event_id", text.jsonp_body(said).alias("body"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def decoded_text(spark, d):
    rows = fx.table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-16LE").alias("content"))
    return pages.decoded(rows, encoding="utf-16-le").select("doc_id", F.sha2("body", 256).alias("hash"))


_KANA = "array_to_string(list_transform(string_split(regexp_replace(lower({}), '[^a-z]', '', 'g'), ''), lambda c: {}), '')"


def _kana_bytes(c):
    """The letters of a text as hiragana in Shift_JIS, a for the first."""
    letters = F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z]", ""), ""), lambda x: x != "")
    return F.unhex(F.array_join(F.transform(letters, lambda x: F.concat(F.lit("82"), F.hex(F.ascii(x) + 62))), ""))


@query("SELECT page_id, sha256(" + _KANA.format("html", "chr(ascii(c) - 97 + 12353)") + ") AS hash FROM pages")
def decoded_shift_jis(spark, d):
    """Whole pages whose letters are kana of two bytes."""
    rows = fx.table(spark, d, "pages").select("page_id", _kana_bytes(F.col("html")).alias("content"))
    return pages.decoded(rows).select("page_id", F.sha2("body", 256).alias("hash"))


@query("SELECT page_id, " + _KANA.format("url", "'%82%' || printf('%02X', ascii(c) + 62)") + " || ',' || " + _KANA.format("substr(url, 8)", "'%82%' || printf('%02X', ascii(c) + 62)") + " AS places FROM pages")
def tree_places(spark, d):
    """Places in trees of Shift_JIS pages: even pages have the older form, and one of the newer, which then counts for nothing."""
    p = fx.table(spark, d, "pages").withColumns({"long": _kana_bytes(F.col("url")), "short": _kana_bytes(F.col("url").substr(8, 10_000))})
    old, new = F.lit("<a onclick=\"document.viewtree.treedepth.value='"), F.lit('<a data-depth="')
    link = lambda form, close, c: F.concat(form.cast("binary"), c, F.lit(f"{close}\">x</a>" if close == "'" else '">x</a>').cast("binary"))
    older = F.concat(link(new, '"', F.lit("z").cast("binary")), link(old, "'", F.col("long")), link(old, "'", F.lit("").cast("binary")), link(old, "'", F.col("short")))
    newer = F.concat(link(new, '"', F.col("long")), link(new, '"', F.col("short")))
    rows = p.select("page_id", F.when(F.col("page_id") % 2 == 0, older).otherwise(newer).alias("raw"))
    return rows.select("page_id", F.array_join(pages.tree_places("raw"), ",").alias("places"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' of ' || p_type ELSE upper(p_name) || chr(10) || p_type || ' of ' || p_brand END AS body, CASE WHEN p_partkey % 2 = 1 THEN upper(p_name) || chr(10) || p_type || ' of ' || p_brand END AS layer FROM part")
def file_texts(spark, d):
    """Old office files and PDF files in one table: the strategy that finds text wins; the PDF's own text stands beside it."""
    p = fx.spread(fx.table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand"))
    office = F.encode(F.concat("p_name", F.lit(" of "), "p_type"), "UTF-16LE")
    pdf = F.concat(F.lit("%PDF-1.4\nstream\nBT ("), F.upper("p_name"), F.lit(") Tj [("), "p_type", F.lit(") 5 ( of ) 7 ("), "p_brand", F.lit(")] TJ ET\nendstream")).cast("binary")
    rows = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, office).otherwise(pdf).alias("content"))
    rows = pages.file_text(rows, [pages.pdf_text_layer, pages.doc_text], usable=lambda s: pages.is_usable(s, 5))
    both = pages.texts_side_by_side(rows, {"layer": pages.pdf_text_layer})
    return both.select("p_partkey", "body", F.nullif("layer", F.lit("")).alias("layer"))


_SHOWN = "regexp_replace(lower({}), '[^a-z]', '', 'g')"
_AS_KANA = "array_to_string(list_transform(string_split({}, ''), lambda c: chr(ascii(c) - 97 + 12353)), '')"


@query(f"""WITH t AS (SELECT p_partkey, {_AS_KANA.format(_SHOWN.format('p_name'))} AS name, {_AS_KANA.format(_SHOWN.format('p_type'))} AS kind, {_AS_KANA.format(_SHOWN.format('p_type || p_name'))} AS maker, p_brand FROM part)
SELECT p_partkey, name || chr(10) || kind || chr(10) || maker || chr(10) || p_brand AS in_order, name || '  ' || maker || chr(10) || kind || '  ' || p_brand AS in_layout FROM t""")
def pdf_layouts(spark, d):
    """PDF files with two columns in a font of its own codes, told by its table, and a plain one: both orders of their text from one pass."""
    codes = lambda c: F.array_join(F.transform(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z]", ""), ""), lambda x: x != ""), lambda x: F.concat(F.lit("00"), F.lpad(F.hex(F.ascii(x) - 96), 2, "0"))), "")
    table = "begincmap\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n2 beginbfrange\n<0001> <000D> <3041>\n<000E> <000F> [<304E> <304F>]\nendbfrange\n11 beginbfchar\n" + "".join(f"<{i:04X}> <{0x3040 + i:04X}>\n" for i in range(16, 27)) + "endbfchar\nendcmap"
    content = F.concat(
        F.lit("BT /F1 10 Tf 50 700 Td <"), codes("p_name"), F.lit("> Tj 0 -20 Td <"), codes("p_type"), F.lit("> Tj ET\nBT /F1 10 Tf 1 0 0 1 300 700 Tm <"), codes(F.concat("p_type", "p_name")),
        F.lit("> Tj /F2 10 Tf 20 TL T* [("), F.regexp_replace("p_brand", "#.*", ""), F.lit(") -20 (#) ("), F.regexp_replace("p_brand", ".*#", ""), F.lit(")] TJ ET"),
    )
    body = F.concat(
        F.lit("%PDF-1.5\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R /F2 7 0 R >> >> >>\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>\nendobj\n4 0 obj\n<< >>\nstream\n"), content,
        F.lit(f"\nendstream\nendobj\n5 0 obj\n<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>\nendobj\n6 0 obj\n<< >>\nstream\n{table}\nendstream\nendobj\n7 0 obj\n<< /Type /Font /Subtype /Type1 >>\nendobj\n"),
    )
    rows = fx.spread(fx.table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")).select("p_partkey", body.cast("binary").alias("content"))
    return pages.texts_side_by_side(rows, {"in_order": pdf.text_in_order, "in_layout": pdf.text_in_layout}).drop("content")


# the rules above over the whole texts of pages and documents

_LATIN, _KANAS = "abcdefghijklmnopqrstuvwxyz", "ぁあぃいぅうぇえぉおかがきぎくぐけげこごさざしじすずせぜ"


@query("SELECT page_id, sha256(" + _NAMED.format("html") + ") AS hash FROM pages")
def entities_in_pages(spark, d):
    """Pages in which every e and every r is a numbered reference, beside the named ones that they have."""
    said = F.replace(F.replace("html", F.lit("e"), F.lit("&#101;")), F.lit("r"), F.lit("&#114;"))
    return fx.table(spark, d, "pages").select("page_id", F.sha2(shape.decoded_entities(said), 256).alias("hash"))


_SPACED = "([ぁ-ぜ])[ 　]+([ぁ-ぜ])"


@query(f"WITH k AS (SELECT doc_id, translate(lower(text), '{_LATIN}', '{_KANAS}') AS t FROM documents) SELECT doc_id, sha256(regexp_replace(regexp_replace(t, '{_SPACED}', '\\1\\2', 'g'), '{_SPACED}', '\\1\\2', 'g')) AS hash FROM k")
def despaced_documents(spark, d):
    """Documents in kana, with their own spaces, punctuation and accented letters."""
    kana = F.translate(F.lower("text"), _LATIN, _KANAS)
    return fx.table(spark, d, "documents").select("doc_id", F.sha2(text.despace_cjk(kana), 256).alias("hash"))


_LINK = "'(?is)<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>'"


@query(f"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, {_LINK}, 1)) AS href, unnest(regexp_extract_all(html, {_LINK}, 2)) AS label FROM pages),
r AS (SELECT page_id, href, replace(replace(replace(label, 'th', '会議録'), 'an', '【表紙】'), 'er', '一般質問') AS a, replace(replace(href, 're', 'minutes'), 'on', 'agenda') AS h FROM h)
SELECT page_id, href, a AS label, NOT regexp_matches(a, '【表紙】|【議事日程】') AND NOT regexp_matches(h, 'frontcover|hyoushi|agenda|nittei') AND (regexp_matches(a, '【会議録】|一般質問|委員会|^[0-9]+\\.') OR regexp_matches(h, 'minutes|kaigiroku')) AS minutes FROM r""")
def minutes_links_in_pages(spark, d):
    """All links of pages, with syllables of their labels and addresses replaced by the words that the rule looks for."""
    links = fx.table(spark, d, "pages").select("page_id", F.explode(text.anchors("html")).alias("a")).select("page_id", "a.href", "a.label")
    put = lambda c, *pairs: F.replace(put(c, *pairs[:-1]), F.lit(pairs[-1][0]), F.lit(pairs[-1][1])) if pairs else F.col(c)
    links = links.select("page_id", "href", put("label", ("th", "会議録"), ("an", "【表紙】"), ("er", "一般質問")).alias("label"), put("href", ("re", "minutes"), ("on", "agenda")).alias("h"))
    return links.select("page_id", "href", "label", shape.is_minutes_link("label", "h").alias("minutes"))


@query("""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text <> ''), g AS (SELECT doc_id, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS i FROM t),
c AS (SELECT doc_id, ('0x' || substr(md5(substr(t, i, 3)), 1, 8))::bigint % 256 AS slot, count(*) AS n FROM g GROUP BY 1, 2), l AS (SELECT doc_id, sqrt(sum(n * n)::double) AS l FROM c GROUP BY 1)
SELECT c.doc_id, slot::int AS slot, round(n / l, 9) AS value FROM c JOIN l ON c.doc_id = l.doc_id""")
def gram_vectors(spark, d):
    """Vectors of all documents that need no model, one row for each slot that is not zero."""
    rows = replies.gram_vectors(fx.table(spark, d, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.posexplode("embedding").alias("slot", "value")).filter("value <> 0").select("doc_id", "slot", F.round("value", 9).alias("value"))


# shapes

@query("SELECT o_orderkey, 'of ' || o_orderpriority || '|B & c' AS headings, 'one <b>' || o_orderkey || '</b>|' || chr(10) || 'two' AS bodies FROM orders")
def sections(spark, d):
    html = F.concat(F.lit('<p>before</p><h3 class="x">of <i>'), "o_orderpriority", F.lit("</i></h3>one <b>"), F.col("o_orderkey").cast("string"), F.lit("</b><H3> B & c </H3>\ntwo"))
    s = fx.table(spark, d, "orders").select("o_orderkey", shape.sections(html).alias("s"))
    return s.select("o_orderkey", F.array_join("s.heading", "|").alias("headings"), F.array_join("s.body", "|").alias("bodies"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '議 事　の 経 過 ' || text ELSE 'list of names ' || text END = body AS same FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN '議 事　の 経 過 ' || text ELSE 'list of names ' || text END AS body FROM documents)")
def proceedings(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("list of names "), F.when(F.col("doc_id") % 2 == 0, "議 事　の 経 過 ").otherwise(""), "text").alias("whole"))
    want = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("議 事　の 経 過 "), "text")).otherwise(F.col("whole"))
    return docs.select("doc_id", (shape.from_proceedings("whole") == want).alias("same"))


@query("SELECT c_custkey, '本日の会議を開きます。' || chr(10) || c_name || chr(10) || 'It is a long line of the second page.' AS body FROM customer")
def merged_pages(spark, d):
    first = F.concat(F.lit("12\n 会議録 \n\n第１日\n本日の会議を開きます。\n"), "c_name")
    whole = F.array(first, F.lit("13\n会議録"), F.lit("\n会議録\nIt is a long line of the second page.\n"))
    return fx.spread(fx.table(spark, d, "customer").select("c_custkey", "c_name")).select("c_custkey", shape.merged_pages(whole).alias("body"))


@query("SELECT c_custkey, c_name || '日&A本 <x> &#99999999; &#x41;' AS body FROM customer")
def entities(spark, d):
    return fx.table(spark, d, "customer").select("c_custkey", shape.decoded_entities(F.concat("c_name", F.lit("&#26085;&#38;&amp;#65;本&nbsp;&lt;x&gt; &#99999999; &#x41;"))).alias("body"))


_LABELS, _HREFS = ("【会議録】", "【表紙】", "一般質問", "3.山田", "予算", "【議事日程】委員会"), ("/a.pdf", "/minutes/b.pdf", "/hyoushi.pdf", "/kaigiroku3.pdf", "/nittei.pdf")


@query(f"""WITH l AS (SELECT doc_id, {_chosen('doc_id', *_LABELS)} AS a, {_chosen('doc_id', *_HREFS)} AS h FROM documents) SELECT doc_id,
NOT regexp_matches(a, '【表紙】|【議事日程】') AND NOT regexp_matches(h, 'frontcover|hyoushi|agenda|nittei') AND (regexp_matches(a, '【会議録】|一般質問|委員会|^[0-9]+\\.') OR regexp_matches(h, 'minutes|kaigiroku')) AS minutes FROM l""")
def minutes_links(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", shape.is_minutes_link(_choose("doc_id", *_LABELS), _choose("doc_id", *_HREFS)).alias("minutes"))


_PATHS = ("/a/b.asp?x=1", "/VOICES/g08v.asp", "", "/", "/c/d/")


@query(f"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') || {_chosen('page_id', *_PATHS)} AS u FROM pages) SELECT page_id, CASE WHEN page_id % 5 NOT IN (2, 3) THEN lower(regexp_extract(u, '^[a-z]+://[^/]+')) END AS origin, {_chosen('page_id', '/a', '/VOICES', None, None, '/c/d')} AS base_path FROM u""")
def base_paths(spark, d):
    u = F.concat(F.regexp_extract("url", "^([a-z]+://[^/]+)", 1), _choose("page_id", *_PATHS))
    return fx.table(spark, d, "pages").select("page_id", shape.base_path(u).alias("b")).select("page_id", "b.origin", "b.base_path")


@query("SELECT c_custkey, 'https://example.jp/list?name=' || url_encode(c_name) || '&seg=' || url_encode(c_mktsegment || ' &') AS url FROM customer")
def query_urls(spark, d):
    return fx.table(spark, d, "customer").select("c_custkey", shape.query_url(F.lit("https://example.jp"), "/list", name=F.col("c_name"), seg=F.concat("c_mktsegment", F.lit(" &"))).alias("url"))


@query("SELECT doc_id, 'a,' || lang || ',' || source || ',b,c' AS words FROM documents")
def keyword_lists(spark, d):
    joined = F.concat_ws(",", F.lit(" a"), "lang", F.lit("  "), "source", F.lit("b ,"), "lang", F.lit("c,d , e"))
    return fx.table(spark, d, "documents").select("doc_id", F.array_join(search.keyword_list(joined), ",").alias("words"))


# dates, classes, speakers

@query("""WITH o AS (SELECT o_orderkey, year(o_orderdate)::int AS y, month(o_orderdate)::int AS m, day(o_orderdate)::int AS d FROM orders)
SELECT o_orderkey, '2031-' || lpad(m::varchar, 2, '0') || '-' || lpad(d::varchar, 2, '0') AS month_day, y::int AS of_era, y || '-' || lpad(m::varchar, 2, '0') || '-01' AS estimated, y BETWEEN 1995 AND 1997 AS near, (y - CASE WHEN m < 4 THEN 1 ELSE 0 END)::int AS fiscal FROM o""")
def more_dates(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.year("o_orderdate").alias("y"), F.month("o_orderdate").cast("string").alias("m"), F.dayofmonth("o_orderdate").cast("string").alias("day"))
    era = F.concat(F.lit("平成"), (F.col("y") - 1988).cast("string"), F.lit("年"))
    return o.select(
        "o_orderkey", dates.month_day_date(F.concat(F.lit("（"), text.full_width_digits("m"), F.lit("月"), "day", F.lit("日）")), F.lit("2031")).alias("month_day"), dates.era_year(F.lit("平成"), text.full_width_digits((F.col("y") - 1988).cast("string"))).alias("of_era"),
        dates.estimated_date(F.concat(era, F.lit(" "), "m", F.lit("月定例会"))).alias("estimated"), dates.within_years(F.concat(era, F.lit("の会議")), 1996).alias("near"), dates.fiscal_year("o_orderdate").cast("int").alias("fiscal"),
    )


@query("SELECT p_partkey, CASE p_size % 8 WHEN 4 THEN 'remark' WHEN 5 THEN 'question' WHEN 6 THEN 'answer' END AS kind FROM part")
def kind_codes(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", classify.kind_by_code(F.col("p_size") % 8).alias("kind"))


_SAID = ("山　田 太", "山 田", "議 長 が", "a b c", "山田　太郎 君", " 松 本　清 張 ")


@query(f"SELECT doc_id, {_chosen('doc_id', 'y', 'n', 'y', 'n', 'n', 'y')} = 'y' AS label, length({_trim(_chosen('doc_id', *_SAID))}) < 5 OR {_chosen('doc_id', 'y', 'n', 'y', 'n', 'n', 'y')} = 'y' AS noise FROM documents")
def speaker_labels(spark, d):
    c = _choose("doc_id", *_SAID)
    return fx.table(spark, d, "documents").select("doc_id", classify.is_speaker_label(c).alias("label"), classify.is_noise(c).alias("noise"))


_AGENTS = ("Mozilla/5.0", "curl/8.1", "", "Python-Requests/2", "GPTBot/1.0", "Safari")


@query(f"SELECT user_id, event_id, {_chosen('event_id', 'n', 'y', 'y', 'y', 'y', 'n')} = 'y' AS blocked, {_chosen('event_id', 'y', 'n', 'y', 'n')} = 'y' AS allowed FROM events")
def agents(spark, d):
    mail = _choose("event_id", "a@Example.jp", "a@b.example.com", "x@sub.town.jp", "none")
    return fx.table(spark, d, "events").select("user_id", "event_id", classify.is_blocked_agent(_choose("event_id", *_AGENTS)).alias("blocked"), classify.is_allowed_domain(mail, ["example.jp", "*.town.jp"]).alias("allowed"))


_HEADS = ("３．町長（山田太郎君） 本日は", "12. 総務課長(佐藤 花子) おはよう", "番外 町長")
_TALK = ("○議長（山田太郎君） 開会します。", "○１７番（佐藤君） 質問します。", "◎山田総務部長　お答えします。", "◯川田 はい。", "町長（林君）　ただいま")


@query(f"""SELECT doc_id, {_chosen('doc_id', '3', '12', None)}::int AS seat, {_chosen('doc_id', '町長', '総務課長', None)} AS seat_role, {_chosen('doc_id', '山田太郎', '佐藤 花子', None)} AS seat_name,
{_chosen('doc_id', '議長', '議員', '部長', None, '町長')} AS role, {_chosen('doc_id', '山田太郎', '佐藤', '山田総務', '川田', '林')} AS name, {_chosen('doc_id', '開会します。', '質問します。', 'お答えします。', 'はい。', 'ただいま')} AS content FROM documents""")
def more_headers(spark, d):
    s = fx.table(spark, d, "documents").select("doc_id", speakers.seat_header(_choose("doc_id", *_HEADS)).alias("h"), speakers.utterance(_choose("doc_id", *_TALK)).alias("u"))
    return s.select("doc_id", "h.seat", F.col("h.role").alias("seat_role"), F.col("h.name").alias("seat_name"), "u.role", "u.name", "u.content")


_TITLES = ("町長（山田太郎君）", "（佐藤議員）", "日程第１", "総務課長(林)")
_VOICES = ("◯議長（山田太郎君）", "○総務部長", "◎ 佐藤（ 花子さん）")


@query(f"SELECT doc_id, {_chosen('doc_id', '町長', None, None, None)} AS role, {_chosen('doc_id', '山田太郎', '佐藤', None, None)} AS name, {_chosen('doc_id', '議長', '総務部長', '佐藤')} AS voice_role, {_chosen('doc_id', '山田太郎', None, '花子')} AS voice_name FROM documents")
def titles(spark, d):
    s = fx.table(spark, d, "documents").select("doc_id", speakers.schedule_title(_choose("doc_id", *_TITLES)).alias("s"), speakers.voice_title(_choose("doc_id", *_VOICES)).alias("v"))
    return s.select("doc_id", "s.role", "s.name", F.col("v.role").alias("voice_role"), F.col("v.name").alias("voice_name"))


# page families

def _said(spark, d):
    """Turns as utterances of a page: who, and the words, which hold no markup."""
    c = fx.table(spark, d, "conversations")
    return c.select("conv_id", "turn", "role", F.concat(F.lit("said "), F.col("turn").cast("string"), F.lit(" by "), "role").alias("words"))


def _page(rows, part):
    return rows.groupBy(F.col("conv_id").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", part.alias("part")))), lambda x: x["part"]), "").alias("body"))


_FAMILY = """WITH t AS (SELECT conv_id AS page_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS position, role, 'said ' || turn || ' by ' || role AS words FROM conversations),
u AS (SELECT page_id, position + {shift} AS position, {kind} AS kind, {name} AS speaker_name, {who} AS speaker_role, {words} AS content FROM t WHERE {keep})
SELECT page_id, position::int AS position, kind, speaker_name, speaker_role, content, sha256({hash} || content) AS content_hash,
  coalesce(sum(length(content) + 1) OVER (PARTITION BY page_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start_offset FROM u"""
_ROLE = "CASE role WHEN 'assistant' THEN '総務部長' WHEN 'user' THEN '山田議員' ELSE '議長' END"
_KIND = "CASE role WHEN 'assistant' THEN 'answer' WHEN 'user' THEN 'question' ELSE 'remark' END"


def _role():
    return F.when(F.col("role") == "assistant", "総務部長").when(F.col("role") == "user", "山田議員").otherwise("議長")


def _utterances(found, *more):
    return found.select("page_id", "position", "kind", "speaker_name", "speaker_role", "content", "content_hash", "start_offset", *more)


#: Layouts of a page by its number of turns: a turn with a nested list, in the markup of each generation, then what no layout reads.
_LAYOUTS = (
    """<li class="voice-block border" data-voice-no="{n}" data-voice-title="◯{who}（林君）">\n<ul><li>{n}</li></ul>\n<p class="voice__text textwrap">◯{who}（林君）〔登壇〕　{words}<br />&amp; so on</p><p class="voice__text">again</p></li>\n<li class="voice_block" data-voice-title="◯{who}"><p class="voice__text"> </p></li>\n""",
    """<li>\n<div class="row voice__header hidden-print" role="button"><div class="col-md-9"><div class="voice__name"><span class="voice__number">{n}: </span>\n<span class="voice__title">◯{who}（林君）</span></div></div></div>
<div class="voice__textwrap"><div class="row voice__text voice__text--print" id="c-{n}"><div><p class="js-textwrap-container">\n<span class="visible-print-block">{n}: </span>◯{who}（林君）{words}<br>&amp; so on\n</p></div></div></div></li>\n""",
    """<div class="page-text__voice" id="VoiceNo{n}"><p class="page-text__text textwrap">\n<span class="page-text__number VoiceAnchor" data-voiceno="{n}">{n}</span>\n◯{who}（林君）　{words}<br/>&amp; so on\n</p></div>\n""",
)


@query(_FAMILY.format(shift=0, kind=_KIND, name="'林'", who=_ROLE, words="words || chr(10) || '& so on'", keep="true", hash="''").replace("start_offset FROM u", "start_offset, (count(*) OVER (PARTITION BY page_id) % 3)::int AS layout FROM u"))
def family_voices(spark, d):
    """Turns as pages of the three generations of markup, elements in elements, among scripts and other text."""
    said = _said(spark, d).withColumn("layout", F.count("*").over(Window.partitionBy("conv_id")) % 3)
    part = F.lit("")
    for i, form in enumerate(_LAYOUTS):
        pieces = re.split("({n}|{who}|{words})", form)
        made = F.concat(*[{"{n}": F.col("turn").cast("string"), "{who}": _role(), "{words}": F.col("words")}.get(x, F.lit(x)) for x in pieces if x])
        part = F.when(F.col("layout") == i, made).otherwise(part)
    rows = _page(said, part).withColumn("body", F.concat(F.lit('<html><script>if (a<b) { x = "<p class=voice__text>no</p>" }</script><body><p>no<ul class="page-list">\n'), "body", F.lit("</ul><!-- <p class=page-text__text>no</p> --></body></html>")))
    found = pages.utterances(rows, pages.FAMILIES["dbsearch"])
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("position")) - 1
    layouts = said.select(F.col("conv_id").alias("page_id"), F.col("layout").cast("int").alias("layout")).distinct()
    return _utterances(found.withColumn("position", place).join(layouts, "page_id"), "layout")


@query(_FAMILY.format(shift=0, kind=_KIND, name="'林'", who=_ROLE, words="words", keep="role <> 'system'", hash="page_id || ':' || position || ':'").replace("sha256(page_id || ':' || position || ':' || content)", "sha256(page_id || ':' || position || content)"))
def family_schedules(spark, d):
    said = _said(spark, d).withColumn("code", F.when(F.col("role") == "assistant", 6).when(F.col("role") == "user", 5).otherwise(1)).withColumn("title", F.concat(_role(), F.lit("（林君）")))
    one = F.struct("turn", "role", F.struct("code", "title", F.concat("title", F.lit("　"), "words").alias("body")).alias("j"))
    rows = said.groupBy(F.col("conv_id").alias("page_id")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["j"])).alias("body"))
    return _utterances(pages.utterances(rows, pages.FAMILIES["discussnet_ssp"]))


def _mark():
    return F.when(F.col("role") == "assistant", "◎").when(F.col("role") == "user", "◆").otherwise("○")


@query(_FAMILY.format(shift=2, kind=_KIND, name="'林'", who=_ROLE, words="words", keep="true", hash="''"))
def family_marked(spark, d):
    """Pages of whole meetings with an anchor before each turn, after a roster; headings stand among them."""
    part = F.concat(F.lit('<A NAME="HUID1'), "turn", F.lit('"></A>'), _mark(), _role(), F.lit("（林君）　"), "words", F.lit("<BR>\n"))
    rows = _page(_said(spark, d), part).withColumn("body", F.concat(F.lit('<BODY>\n<A NAME="HUID100"></A>令和　６年定例会<BR><BR>出席議員<BR>\n'), "body", F.lit('<A NAME="HUID999"></A>△散会の宣告<BR>\n</BODY>')))
    found = pages.utterances(rows, pages.FAMILIES["gijiroku_com"])
    return _utterances(found)


@query(_FAMILY.format(shift=1, kind="CASE role WHEN 'assistant' THEN 'answer' WHEN 'user' THEN 'question' ELSE 'remark' END", name="CASE role WHEN 'assistant' THEN '川田青星' ELSE '林' END", who="CASE role WHEN 'assistant' THEN '分科会部長' WHEN 'user' THEN '山田議員' ELSE '議長' END", words="words", keep="true", hash="''"))
def family_sidebar(spark, d):
    """Meetings that a sidebar lists, a landed page for each turn, joined in the sidebar's order."""
    said = _said(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role"))).withColumn("huid", F.concat(F.lit("7"), F.col("place").cast("string")))
    entry = lambda huid, label: F.concat(F.lit('<TR><TD><A NAME="'), huid, F.lit('"></A><A HREF="voiweb.exe?HUID='), huid, F.lit('"><B>'), label, F.lit("</B></A></TD></TR>\n"))
    side = _page(said, entry(F.col("huid"), F.concat(_mark(), F.lit("林君")))).select(F.col("page_id"), F.concat(entry(F.lit("70"), F.lit(" (名簿) ")), "body", entry(F.lit("79999"), F.lit("△散会"))).alias("html"))
    head = F.when(F.col("role") == "assistant", F.concat(F.lit("◎"), F.lit("川田青星　分科会部長　　"))).otherwise(F.concat(_mark(), _role(), F.lit("（林君）　")))
    page = F.concat(F.lit('<HTML><BODY>林君<BR><A NAME="HUID'), "huid", F.lit('"></A>'), head, "words", F.lit("<BR>\n<FORM>◎部長（林君）　next</FORM></BODY></HTML>"))
    landed = said.select(F.col("conv_id").alias("page_id"), "huid", page.alias("html"))
    rosters = said.select(F.col("conv_id").alias("page_id"), F.lit("70").alias("huid"), F.lit('<A NAME="HUID70"></A>○議長（林君）　roster').alias("html")).distinct()
    return _utterances(services.gijiroku_utterances(side, landed.unionByName(rosters), "page_id"))


@query(_FAMILY.format(shift=0, kind="NULL", name="'林'", who=_ROLE, words="words", keep="true", hash="''").replace("kind, speaker_name", "speaker_name").replace("content, sha256('' || content) AS content_hash,", "content,").replace("NULL AS kind, ", ""))
def utterances_in_sql(spark, d):
    """Landed pieces of meetings through the table function, one call with the family's name."""
    tables.register(spark)
    said = _said(spark, d).select(F.col("conv_id").alias("page_id"), F.struct("turn", "role").alias("place"), F.concat(_mark(), _role(), F.lit("（林君）　"), "words", F.lit("<BR>\n")).alias("piece"))
    headings = said.groupBy("page_id").agg(F.max("place").alias("place")).select("page_id", "place", F.lit("△散会の宣告").alias("piece"))
    found = spark.sql("SELECT * FROM family_utterances(TABLE(SELECT page_id, place, piece FROM {pieces}), 'gijiroku_com')", pieces=said.unionByName(headings))
    return found.select("page_id", "position", F.col("name").alias("speaker_name"), F.col("role").alias("speaker_role"), "content", "start_offset")


@query(f"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>|<a\\s[^>]*?href\\s*=\\s*["''][^"'']*["''][^>]*>.*?</a>')) AS block, generate_subscripts(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>|<a\\s[^>]*?href\\s*=\\s*["''][^"'']*["''][^>]*>.*?</a>'), 1) AS k FROM pages),
t AS (SELECT page_id, k, block, regexp_matches(block, '(?i)^<a') AS link, trim(regexp_replace({_NAMED.format(_untag("block"))}, '\\s+', ' ', 'g')) AS said FROM b),
h AS (SELECT *, last_value(CASE WHEN NOT link THEN said END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM t)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::int AS pos, regexp_extract(block, '(?is)href\\s*=\\s*["'']([^"'']*)', 1) AS href, said AS label, heading FROM h WHERE link""")
def links_in_sql(spark, d):
    """Links of pages through the table function, called laterally."""
    tables.register(spark)
    return spark.sql("SELECT p.page_id, l.pos, l.href, l.label, l.heading FROM {pages} p, LATERAL page_links(p.html) l", pages=fx.table(spark, d, "pages"))


_LINK = "(?is)<a\\s[^>]*?href\\s*=\\s*[\"''][^\"'']*[\"''][^>]*>.*?</a>"


@query(f"""WITH d AS (SELECT page_id, lower(html) AS low, html || ' 2024-0' || (page_id % 9 + 1) || '-15 ' AS html FROM pages),
b AS (SELECT page_id, html, unnest(regexp_extract_all(html, '{_LINK}')) AS m, unnest(string_split_regex(html, '{_LINK}')[1 : len(regexp_extract_all(html, '{_LINK}'))]) AS gap, unnest(range(len(regexp_extract_all(html, '{_LINK}')))) AS pos FROM d),
p AS (SELECT *, (sum(length(gap) + length(m)) OVER (PARTITION BY page_id ORDER BY pos))::bigint AS e FROM b),
a AS (SELECT *, substr(html, e + 1, 300) AS after FROM p)
SELECT page_id, pos::int AS pos, regexp_extract(m, '(?is)href\\s*=\\s*["'']([^"'']*)', 1) AS href, coalesce(nullif(regexp_extract(after, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), ''), nullif(regexp_replace(regexp_extract(after, '[0-9]{{4}}年[0-9]{{1,2}}月[0-9]{{1,2}}日'), '([0-9]+)年([0-9]+)月([0-9]+)日', '\\1-\\2-\\3'), '')) AS held_on FROM a""")
def links_with_dates(spark, d):
    """Links with the date that stands behind them; each page ends with one, which its last links reach."""
    p = fx.table(spark, d, "pages")
    html = F.concat("html", F.lit(" 2024-0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit("-15 "))
    return services.links_with_dates(p.select("page_id", html.alias("html"))).select("page_id", "pos", "href", "held_on")


_TREE = """o AS (SELECT c_nationkey::varchar AS site, year(o_orderdate)::int - 1988 AS era, o_orderpriority AS body, o_orderdate::date AS day FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT DISTINCT site, day, CASE WHEN body = '5-LOW' THEN NULL ELSE body END AS body FROM o)"""


@query(f"""WITH {_TREE}, w AS (SELECT site, day, min(CASE WHEN body IS NULL THEN '' WHEN body = '4-NOT SPECIFIED' THEN 'z' ELSE body END) AS first FROM m GROUP BY 1, 2)
SELECT site, day AS held_on, CASE first WHEN '' THEN '' WHEN 'z' THEN '4-NOT SPECIFIED ' || month(day) || ' ' ELSE first || ' ' END || day AS title, 'H' || lpad((year(day) - 1988)::varchar, 2, '0') || strftime(day, '%m%d') || 'A' AS file FROM w""")
def tree_meetings(spark, d):
    """A tree of tabs from orders: years, then priorities, then for one of them months; meetings without a priority stand under their year."""
    o, c = fx.table(spark, d, "orders"), fx.table(spark, d, "customer")
    m = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").cast("string").alias("site"), F.concat(F.lit("平成 "), F.year("o_orderdate") - 1988, F.lit("年")).alias("tab"), F.col("o_orderpriority").alias("body"), F.col("o_orderdate").cast("date").alias("day")).distinct()
    file = F.concat(F.lit("H"), F.lpad((F.year("day") - 1988).cast("string"), 2, "0"), F.date_format("day", "MMdd"), F.lit("A"))
    tab = lambda x: F.concat(F.lit("<A HREF=\"javascript:document.viewtree.submit()\"onClick=\"document.viewtree.treedepth.value='"), x, F.lit("'\">tab</A>\n"))
    link = F.concat(F.lit('<A HREF="/'), "site", F.lit('/cgi-bin3/ResultFrame.exe?Code=x&amp;fileName='), file, F.lit('&amp;startPos=0">minutes</A>\n'))
    month = F.concat("body", F.lit(" "), F.month("day").cast("string"))
    low, deep = F.col("body") == "5-LOW", F.col("body") == "4-NOT SPECIFIED"
    page = lambda node, what, rows=m: rows.select("site", node.alias("node"), what.alias("part"))
    parts = page(F.lit(None).cast("string"), tab(F.col("tab")))
    # each page repeats the tabs above it; a body's tab is told from that of other years
    body = F.concat("tab", F.lit("/"), "body")
    for node, what, which in ((F.col("tab"), tab(F.col("tab")), None), (F.col("tab"), link, low), (F.col("tab"), tab(body), ~low), (body, link, ~low & ~deep), (body, tab(body), ~low), (body, tab(F.concat("tab", F.lit("/"), month)), deep), (F.concat("tab", F.lit("/"), month), link, deep)):
        parts = parts.unionByName(page(node, what, m if which is None else m.filter(which)))
    html = F.array_join(F.array_sort(F.collect_set("part")), "")
    found = services.tree_meetings(parts.groupBy("site", "node").agg(html.alias("html")))
    return found.select("site", F.col("held_on").cast("date").alias("held_on"), F.regexp_replace("title", "^平成 \\d+年/", "").alias("title"), "file")


@query(_FAMILY.format(shift=1, kind=_KIND, name="'林'", who="CASE role WHEN 'assistant' THEN '部長' WHEN 'user' THEN '議員' ELSE '議長' END", words="words", keep="true", hash="''"))
def family_frames(spark, d):
    """Turns that a frame of speakers lists, by its form or by its links alone, each with a landed text."""
    said = _said(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role"))).withColumn("position", (F.col("place") * 37).cast("string"))
    forms = F.count("*").over(Window.partitionBy("conv_id")) % 2 == 0
    said = said.withColumn("form", forms).withColumn("file", F.concat(F.lit("H"), F.lpad(F.col("conv_id").cast("string"), 6, "0")))
    link = F.concat(F.lit('<A HREF="/x/cgi-bin3/r_TextFrame.exe?code/'), "file", F.lit("/"), "position", F.lit('/0//10/1" TARGET="TEXTW">'), _role(), F.lit("</A>\n"))
    box = F.when(F.col("form"), F.concat(F.lit('<input type="checkbox" name="downloadPos" value="'), "position", F.lit('" >'))).otherwise("")
    rows = _page(said, F.concat(box, link)).join(said.select(F.col("conv_id").alias("page_id"), "form", "file").distinct(), "page_id")
    form = F.concat(F.lit('<FORM name="download" action="GetPerson.exe"><input type="hidden" name="Code" value="code"><input value="'), "file", F.lit('" type="hidden" name="fileName">'))
    lists = rows.select("page_id", F.concat(F.when(F.col("form"), form).otherwise(""), F.lit('<A HREF="r_TextFrame.exe?code/'), "file", F.lit('/0/0">議事日程</A>'), "body").alias("html"))
    head = F.when(F.col("role") == "assistant", "部長（林君）").when(F.col("role") == "user", "議員（林君）").otherwise("議長（林君）")
    texts = said.select(F.lit("code").alias("code"), "file", "position", F.concat(F.when(F.col("place") == 1, "会議名\n").otherwise(""), F.lit("○"), head, F.lit("　"), F.regexp_replace("words", " ", "\n　")).alias("body"))
    turns = services.speaker_positions(lists, "page_id")
    return _utterances(pages.utterances(services.assembled_texts(turns, texts, "page_id"), pages.FAMILIES["kensakusystem"]))


@query(_FAMILY.format(shift=1, kind=_KIND, name="CASE role WHEN 'assistant' THEN '林' WHEN 'user' THEN '山田' ELSE '林' END", who="CASE role WHEN 'assistant' THEN '部長' WHEN 'user' THEN '議員' ELSE '議長' END", words="words", keep="true", hash="''"))
def family_plain(spark, d):
    head = F.when(F.col("role") == "assistant", "部長（林君）").when(F.col("role") == "user", "山田議員").otherwise("議長（林君）")
    part = F.concat(F.when(F.col("turn") == 0, "Minutes of the day ").otherwise(""), F.lit("○"), head, F.lit("　 "), "words", F.lit("\n"))
    rows = _page(_said(spark, d), part).withColumn("body", F.when(F.col("body").startswith("Minutes"), F.col("body")).otherwise(F.concat(F.lit("Minutes "), "body")))
    return _utterances(pages.utterances(rows, pages.FAMILIES["custom"]))


@query(_FAMILY.format(shift=0, kind=_KIND, name="CASE role WHEN 'assistant' THEN '林' WHEN 'user' THEN '山田' ELSE '林' END", who="CASE role WHEN 'assistant' THEN '部長' WHEN 'user' THEN '議員' ELSE '議長' END", words="words || ' and so on'", keep="true", hash="''"))
def line_utterances(spark, d):
    """Extracted lines with page numbers and stage directions between them."""
    head = F.when(F.col("role") == "assistant", "部長（林君）").when(F.col("role") == "user", "山田議員").otherwise("議長（林君）")
    part = F.concat(F.lit("○"), head, F.lit("　"), "words", F.lit("\n－ 3 －\n（拍手）\nand  so on\n\f"))
    return _utterances(pages.lines_to_utterances(_page(_said(spark, d), part)))


@query("SELECT doc_id, '○議長 開会。' || lang || '○町長 はい。' AS body FROM documents")
def without_contents(spark, d):
    body = F.concat(F.lit("目次○開会……………3○散会・・・・9"), F.lit("○議長 開会。"), "lang", F.lit("○町長 はい。"))
    return fx.table(spark, d, "documents").select("doc_id", pages.drop_contents_table(body).alias("body"))


_BLOCK = "(?is)<h[1-6][^>]*>.*?</h[1-6]>|<a\\s[^>]*?href\\s*=\\s*[\"''][^\"'']*[\"''][^>]*>.*?</a>"


@query(f"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '{_BLOCK}')) AS block, generate_subscripts(regexp_extract_all(html, '{_BLOCK}'), 1) - 1 AS pos FROM pages),
h AS (SELECT *, last_value(CASE WHEN regexp_matches(block, '(?i)^<h[1-6]') THEN {_trim(_untag('block'))} END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM b),
l AS (SELECT page_id, pos, heading, regexp_extract(block, '(?is)href\\s*=\\s*["'']([^"'']*)', 1) AS href, trim(regexp_replace({_NAMED.format(_untag("regexp_extract(block, '(?is)^<a\\s[^>]*>(.*?)</a>', 1)"))}, '{_BLANK}+', ' ', 'g'), ' ') AS label FROM h WHERE regexp_matches(block, '(?i)^<a'))
SELECT page_id, pos::int AS pos, heading, href, label FROM l QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1""")
def page_links(spark, d):
    """Links under their headings, the first to each address of a page."""
    return pages.first_links(pages.dated_links(fx.table(spark, d, "pages"))).select("page_id", "pos", "heading", "href", "label")


@query("""WITH m AS (SELECT lpad(c_nationkey::varchar, 3, '0') AS page, c_custkey, year(DATE '1990-01-01' + (c_custkey % 4000)::int) || '-' || lpad(month(DATE '1990-01-01' + (c_custkey % 4000)::int)::varchar, 2, '0') || '-' || lpad(day(DATE '1990-01-01' + (c_custkey % 4000)::int)::varchar, 2, '0') AS held_on FROM customer)
SELECT page AS page_id, 'minutes of ' || held_on AS label, held_on, (row_number() OVER (PARTITION BY page ORDER BY held_on, c_custkey))::int AS place FROM m""")
def dated_list(spark, d):
    """Links of pages whose labels name dates, in order of date and then of their place on the page."""
    c = fx.table(spark, d, "customer")
    day = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("c_custkey") % 4000).cast("int")).cast("string")
    link = F.concat(F.lit('<a href="/m/'), F.col("c_custkey").cast("string"), F.lit('.pdf">minutes of '), day, F.lit("</a>"))
    rows = c.groupBy(F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", link.alias("l")))), lambda x: x["l"]), "\n").alias("html"))
    return pages.links_in_order(pages.dated_links(rows)).select("page_id", "label", "held_on", "place")


@query("SELECT r_name AS \"group\", '2020' AS year, n_name AS type, c_custkey::int AS council_id, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def council_tree(spark, d):
    c, n, r = (fx.table(spark, d, t) for t in ("customer", "nation", "region"))
    councils = c.groupBy("c_nationkey").agg(F.collect_list(F.struct(F.col("c_custkey").alias("council_id"), F.col("c_name").alias("name"))).alias("councils"))
    types = n.join(councils, n.n_nationkey == councils.c_nationkey).groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("name"), "councils")).alias("types"))
    tree = r.join(types, r.r_regionkey == types.n_regionkey).select(F.to_json(F.array(F.struct(F.col("r_name").alias("name"), F.array(F.struct(F.lit("2020").alias("year"), "types")).alias("years")))).alias("body"))
    return pages.council_tree(tree, year=2020)


@query("SELECT c_nationkey::int AS council_id, c_custkey::int AS schedule_id, c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING'")
def schedules(spark, d):
    c = fx.table(spark, d, "customer")
    name = F.when(F.col("c_mktsegment") == "BUILDING", F.concat("c_name", F.lit("別冊"))).otherwise(F.col("c_name"))
    rows = c.groupBy("c_nationkey").agg(F.collect_list(F.struct(F.col("c_custkey").alias("schedule_id"), name.alias("name"))).alias("schedules"))
    return pages.schedules(rows.select(F.to_json(F.array(F.struct(F.col("c_nationkey").alias("council_id"), "schedules"))).alias("body")))


# runs

_SYSTEM = "CASE WHEN contains(base_url, 'dbsr.jp') THEN 'dbsearch' WHEN contains(base_url, 'kensakusystem.jp') THEN 'kensakusystem' ELSE code END"
_ADDRESS = "m AS (SELECT lpad(c_custkey::varchar, 9, '0') AS code, CASE c_mktsegment WHEN 'BUILDING' THEN 'https://www.dbsr.jp/' || c_custkey WHEN 'MACHINERY' THEN 'https://kensakusystem.jp/' || c_custkey WHEN 'HOUSEHOLD' THEN NULL WHEN 'FURNITURE' THEN '' ELSE 'https://town.example.jp/' || c_custkey END AS base_url FROM customer)"


def _councils(spark, d):
    key = F.col("c_custkey").cast("string")
    url = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("https://www.dbsr.jp/"), key)).when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("https://kensakusystem.jp/"), key)).when(F.col("c_mktsegment") == "FURNITURE", "").when(F.col("c_mktsegment") != "HOUSEHOLD", F.concat(F.lit("https://town.example.jp/"), key))
    return fx.table(spark, d, "customer").select(F.lpad(key, 9, "0").alias("code"), url.alias("base_url"))


@query(f"WITH {_ADDRESS} SELECT code, base_url, {_SYSTEM} AS system, 'dbsearch' AS chosen FROM m WHERE contains(base_url, 'dbsr.jp') UNION ALL SELECT code, base_url, {_SYSTEM}, 'custom' FROM m WHERE contains(base_url, 'town.example')")
def scrape_targets(spark, d):
    m = _councils(spark, d)
    adapters = m.select(F.col("code").alias("key")).unionByName(spark.createDataFrame([("dbsearch",)], "key string"))
    return runs.scrape_targets(m, adapters, system="dbsearch").withColumn("chosen", F.lit("dbsearch")).unionByName(runs.scrape_targets(m, adapters, system="custom").withColumn("chosen", F.lit("custom")))


@query("SELECT count(*) AS total, 0::bigint AS pending, count(*) FILTER (o_orderstatus = 'O') AS running, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders")
def job_counts(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    return runs.counts_by_status(fx.table(spark, d, "orders").select(status.alias("status")))


@query("SELECT lpad(o_orderkey::varchar, 12, '0') AS id, o_orderdate::date AS held_on FROM orders WHERE o_custkey = 7 AND o_orderstatus NOT IN ('P', 'F') ORDER BY o_orderdate DESC, id DESC LIMIT 1")
def latest_plenary(spark, d):
    return runs.latest_plenary(fx.meetings(spark, d), "000000007").select("id", "held_on")


@query("SELECT lpad(o_orderkey::varchar, 12, '0') AS id, o_orderdate::date AS held_on FROM orders WHERE o_custkey = 7 AND o_orderkey % 5 = 0 ORDER BY o_orderdate, id LIMIT 3")
def summary_queue(spark, d):
    return runs.summary_queue(fx.meetings(spark, d), "000000007", limit=3).select("id", "held_on")


@query("WITH t AS (SELECT p_partkey AS id, p_brand AS code FROM part) SELECT 'topic' AS kind, id::varchar AS id FROM t WHERE code <> 'Brand#2' UNION ALL SELECT 'link', l_orderkey || '-' || l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM t WHERE code = 'Brand#2')")
def reset_topics(spark, d):
    topics = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("municipality_code"))
    links = fx.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("topic_id"))
    left, kept = runs.reset_topics(topics, links, "Brand#2")
    return left.select(F.lit("topic").alias("kind"), F.col("id").cast("string").alias("id")).unionByName(kept.select(F.lit("link").alias("kind"), F.concat_ws("-", "l_orderkey", "topic_id").alias("id")))


@query("SELECT label, string_agg(vec_id::varchar, ',' ORDER BY vec_id) AS ids FROM embeddings GROUP BY 1")
def vectors_in_order(spark, d):
    items = fx.table(spark, d, "embeddings").groupBy(F.col("label").alias("batch")).agg(F.collect_list(F.struct(F.col("vec_id").alias("index"), F.array(F.col("vec_id").cast("double")).alias("embedding"))).alias("items"))
    found = runs.vectors_in_order(items)
    return found.select(F.col("batch").alias("label"), F.array_join(F.transform("vectors", lambda v: v[0].cast("long").cast("string")), ",").alias("ids"))


@query("WITH a AS (SELECT p_brand, list(DISTINCT p_name) AS a, list(DISTINCT p_name) FILTER (p_size < 25) AS b FROM part GROUP BY 1) SELECT p_brand, coalesce(array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x))), ','), '') AS only_large FROM a")
def byte_lists(spark, d):
    rows = fx.table(spark, d, "part").groupBy("p_brand").agg(F.collect_set(F.encode("p_name", "UTF-8")).alias("a"), F.collect_set(F.when(F.col("p_size") < 25, F.encode("p_name", "UTF-8"))).alias("b"))
    return rows.select("p_brand", F.array_join(F.array_sort(F.transform(runs.without("a", "b"), lambda x: F.decode(x, "UTF-8"))), ",").alias("only_large"))


# replies

_REPLIES = "CASE o_orderkey % 6 WHEN 1 THEN 'empty reply' WHEN 2 THEN 'not JSON' WHEN 3 THEN 'no summary' WHEN 4 THEN 'no topic_digests' WHEN 5 THEN 'a topic lacks a field' END"


@query(f"SELECT o_orderkey, {_REPLIES} AS problem, CASE WHEN o_orderkey % 6 = 0 THEN 'Summary ' || o_orderpriority END AS summary, CASE WHEN o_orderkey % 6 = 0 THEN 1 END AS topics FROM orders")
def summary_replies(spark, d):
    digest = lambda who: F.array(F.struct(F.lit("t").alias("topic"), F.lit("primary").alias("relevance"), F.lit("x").alias("digest"), who.alias("speakers")))
    summary, speaker = F.concat(F.lit("Summary "), "o_orderpriority").alias("summary"), F.array(F.lit("S"))
    kind = F.col("o_orderkey") % 6
    reply = F.when(kind == 0, F.to_json(F.struct(summary, digest(speaker).alias("topic_digests")))).when(kind == 1, " ").when(kind == 2, F.lit('{"summary": "cut')).when(kind == 3, F.to_json(F.struct(digest(speaker).alias("topic_digests")))).when(kind == 4, F.to_json(F.struct(summary)))
    reply = reply.otherwise(F.to_json(F.struct(summary, digest(F.lit(None).cast("array<string>")).alias("topic_digests"))))
    return replies.summary_replies(fx.table(spark, d, "orders").select("o_orderkey", reply.alias("reply"))).select("o_orderkey", "problem", "summary", F.when(F.col("topic_digests").isNotNull(), F.size("topic_digests")).alias("topics"))


@query("SELECT p_brand AS municipality_code, p_name AS canonical_name, '' AS description, (dense_rank() OVER (PARTITION BY p_brand ORDER BY p_name) - 1)::bigint AS position, p_partkey AS member_index FROM part")
def cluster_replies(spark, d):
    c = fx.table(spark, d, "part").groupBy("p_brand", "p_name").agg(F.collect_list("p_partkey").alias("m"))
    one = F.struct(F.col("p_name").alias("canonical_name"), F.lit(None).cast("string").alias("description"), F.col("m").alias("member_indices"))
    rows = c.groupBy(F.col("p_brand").alias("municipality_code")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("clusters"))).alias("reply"))
    return replies.cluster_replies(rows)


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'rows=2' WHEN 1 THEN 'error: no ' || o_orderpriority WHEN 2 THEN 'meeting=Meeting (' || o_orderdate::date || ') topics=3' ELSE '{\"n\":' || o_orderkey || '}' END AS said FROM orders")
def result_summaries(spark, d):
    kind = F.col("o_orderkey") % 4
    rows = F.to_json(F.struct(F.array(F.lit(1), F.lit(2)).alias("rows")))
    error = F.to_json(F.struct(F.concat(F.lit("no "), "o_orderpriority").alias("error")))
    meeting = F.to_json(F.struct(F.lit("m").alias("meetingId"), F.lit("Meeting").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("heldOn"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("topicDigests")))
    said = F.when(kind == 0, rows).when(kind == 1, error).when(kind == 2, meeting).otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("n"))))
    return fx.table(spark, d, "orders").select("o_orderkey", replies.result_summary(said).alias("said"))


@query("""WITH e AS (SELECT user_id AS stream_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'tool_call' WHEN 'view' THEN 'tool_result' WHEN 'signup' THEN 'iteration_start' ELSE 'final_delta' END AS type, (props->>'k')::int % 4 AS iteration, 'search' AS tool, event_id::varchar || ';' AS said FROM events),
t AS (SELECT stream_id, 'tool-' || iteration || '-' || tool AS part, max(seq) AS at, CASE WHEN arg_max(type, seq) = 'tool_call' THEN 'pending' ELSE 'success' END AS status, arg_max(said, seq) AS said FROM e WHERE type IN ('tool_call', 'tool_result') GROUP BY 1, 2),
r AS (SELECT *, count(*) FILTER (type <> 'final_delta') OVER (PARTITION BY stream_id ORDER BY seq) AS run FROM e WHERE type <> 'iteration_start')
SELECT * FROM t UNION ALL SELECT stream_id, 'text', min(seq), NULL, string_agg(said, '' ORDER BY seq) FROM r WHERE type = 'final_delta' GROUP BY stream_id, run""")
def progress(spark, d):
    e = fx.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "tool_call").when(F.col("event_type") == "view", "tool_result").when(F.col("event_type") == "signup", "iteration_start").otherwise("final_delta")
    rows = e.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), kind.alias("type"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("iteration"), F.lit("search").alias("tool"), F.concat(F.col("event_id").cast("string"), F.lit(";")).alias("said"))
    return replies.progress(rows)


_N = "chr(10)"
_NN = "chr(10) || chr(10)"


@query(f"""WITH i AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS of FROM orders),
p AS (SELECT o_custkey, string_agg(CASE WHEN n = of THEN '## Iteration ' || n || ' — final answer' || {_NN} || 'answer ' || o_orderkey
  ELSE '## Iteration ' || n || ' — tool calls' || {_NN} || '### search' || {_NN} || '**Args**' || {_NN} || '```json' || {_N} || '{{"q":' || o_orderkey || '}}' || {_N} || '```' || {_NN} || '**Result**' || {_NN} || '```json' || {_N} || 'null' || {_N} || '```' END, {_NN} ORDER BY n) AS parts, max(n) AS calls FROM i GROUP BY 1)
SELECT c_custkey AS run_id, '# Agent Run — 2024-05-01T00:00:00.000Z' || {_NN} || '- **Preset**: default' || {_N} || '- **Model**: m' || {_N} || '- **Municipality**: (unspecified)' || {_N} || '- **End reason**: final_answer' || {_NN} || '## Question' || {_NN} || c_name || {_NN} || coalesce(parts, '') || {_NN} ||
  '## Usage' || {_NN} || '- Input tokens: ' || c_custkey || {_N} || '- Output tokens: 5' || {_N} || '- API calls: ' || coalesce(calls, 0) || {_N} || '- Estimated cost: n/a (unknown pricing for m)' || {_N} AS markdown FROM customer LEFT JOIN p ON o_custkey = c_custkey""")
def run_logs(spark, d):
    from pyspark.sql import Window

    o, c, none = fx.table(spark, d, "orders"), fx.table(spark, d, "customer"), F.lit(None).cast("string")
    w = Window.partitionBy("o_custkey")
    final = F.col("index") == F.count("*").over(w)
    steps = o.select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy("o_orderkey")).alias("index")).withColumn("kind", F.when(final, "final").otherwise("tool"))
    steps = steps.select(F.col("o_custkey").alias("run_id"), "index", F.lit(0).alias("call"), "kind", F.lit("search").alias("name"), F.to_json(F.struct(F.col("o_orderkey").alias("q"))).alias("args"), none.alias("result"), F.concat(F.lit("answer "), F.col("o_orderkey").cast("string")).alias("text"))
    calls = o.groupBy(F.col("o_custkey").alias("of")).agg(F.count("*").alias("n"))
    heads = c.join(calls, c.c_custkey == calls.of, "left").select(F.col("c_custkey").alias("run_id"), F.lit("2024-05-01 00:00:00").cast("timestamp").alias("started_at"), F.lit("default").alias("preset"), F.lit("m").alias("model"), none.alias("municipality_code"), F.lit("final_answer").alias("end_reason"), none.alias("error"), F.col("c_name").alias("question"), F.col("c_custkey").alias("input_tokens"), F.lit(5).alias("output_tokens"), F.coalesce("n", F.lit(0)).alias("api_calls"), F.lit(None).cast("double").alias("cost"))
    return runs.run_log(heads, steps)


@query("""WITH t AS (SELECT conv_id, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT conv_id, string_split('[' || CASE role WHEN 'user' THEN 'question' WHEN 'assistant' THEN 'answer' ELSE 'remark' END || '] ' || CASE role WHEN 'system' THEN '不明' WHEN 'assistant' THEN 'Speaker assistant/部長' ELSE 'Speaker user/議員' END || ': ' || coalesce(text, ''), chr(10))[1] AS summary FROM t WHERE n = 1)
SELECT conv_id, summary, 'conversation ' || conv_id AS topic FROM f""")
def summaries_made(spark, d):
    """Transcripts through an injected summariser that needs no model, and its replies through the shape check."""
    from ..operators import chunk

    t = chunk.transcript(fx.statements(spark, d), "meeting_id", ["position"]).withColumn("title", F.concat(F.lit("conversation "), F.col("meeting_id").cast("string")))
    made = replies.summary_replies(replies.summarise(t, replies.leading_lines, key="meeting_id"))
    return made.select(F.col("meeting_id").alias("conv_id"), "summary", F.col("topic_digests")[0]["topic"].alias("topic"))


@query("SELECT item_id, length(text)::double AS chars, (length(text) - length(replace(text, ' ', '')))::double AS spaces FROM benchmark")
def embedded(spark, d):
    """Vectors by an injected client."""
    found = replies.embeddings(fx.table(spark, d, "benchmark"), lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts])
    return found.select("item_id", F.col("embedding")[0].cast("double").alias("chars"), F.col("embedding")[1].cast("double").alias("spaces"))
