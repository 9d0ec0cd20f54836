"""The page families that many councils share, from their pages as they have landed to utterances.

* dbsearch: three generations of markup; of a page, the first that gives any utterance holds.
* gijiroku_com: a sidebar that lists the utterances, a page for each, or one page with an anchor before each.
* kensakusystem: a tree of tabs down to three levels, frames that list speakers, and a text for each speaker's turn.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, dates, speakers, text
from ..operators.chunk import offsets
from ..operators.clean import first_wins
from . import markup


def finished(rows: DataFrame, key: str, order: list[str], kind: Column, hash_prefix: Column | None = None) -> DataFrame:
    """Utterances with kind, hash and offsets that run on over a meeting; those without content, and those of no kind, are left out.

    rows: key, the order's columns, speaker_name, speaker_role, content and what kind needs.
    """
    rows = rows.filter(F.coalesce("content", F.lit("")) != "").withColumn("kind", kind).filter("kind is not null")
    rows = offsets(rows, key, order)
    return rows.select(key, *order, "kind", "speaker_name", "speaker_role", "content", text.content_hash("content", hash_prefix).alias("content_hash"), "start_offset", "end_offset")


# dbsearch

def dbsearch_utterances(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Utterances of pages of any of the three generations; position is the place of the text's element on the page.

    1: li elements of class voice-block with the speaker in data-voice-title, their first p.voice__text.
    2: a header with span.voice__title, then div.voice__textwrap with p.js-textwrap-container.
    3: p.page-text__text, with the speaker at the head of the text.
    Numbers that the layouts put into texts (span.visible-print-block, span.page-text__number) are cut out.
    """
    pick = lambda condition, **more: markup.latest(key, condition, **more)
    e = markup.events(pages, key, html).withColumns({
        "block": pick(markup.opens("li", "voice[_-]block") & F.col("token").rlike("(?i)data-voice-title\\s*="), title=markup.attribute("token", "data-voice-title")),
        "header": pick(markup.opens("div", "voice__header")), "wrap": pick(markup.opens("div", "voice__textwrap")), "label": pick(markup.opens("span", "voice__title")),
        "hole": pick(markup.opens("span", "visible-print-block|page-text__number")),
        "said": pick(markup.opens("p", "voice__text|js-textwrap-container|page-text__text"), classes=markup.attribute("token", "class")),
    })
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = F.last(F.when((F.col("kind") == "text") & markup.inside(F.col("label")), F.struct("pos", text.trim_all("token").alias("title"))), ignorenulls=True).over(so_far)
    of = F.col("said.classes")
    layout = (
        F.when(of.contains("voice__text") & markup.inside(F.col("block"), F.col("said.pos")), 1)
        .when(of.contains("js-textwrap-container") & markup.inside(F.col("wrap"), F.col("said.pos")), 2)
        .when(of.contains("page-text__text"), 3)
    )
    title = F.when(F.col("layout") == 1, F.col("block.title")).when((F.col("layout") == 2) & (F.col("named.pos") > F.col("header.pos")), F.col("named.title")).otherwise("")
    own = e.withColumn("named", named).withColumn("layout", layout).filter(markup.inside(F.col("said")) & ~markup.inside(F.col("hole")) & (F.col("pos") != F.coalesce("hole.pos", F.lit(-1))) & F.col("layout").isNotNull() & (F.col("kind") != "note"))
    element = F.when(F.col("layout") == 1, F.col("block.pos")).otherwise(F.col("said.pos"))
    texts = own.groupBy(key, "layout", element.alias("element"), F.col("said.pos").alias("position")).agg(
        F.max(title).alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("raw"))
    texts = first_wins(texts, [key, "layout", "element"], [F.col("position")]).withColumn("raw", text.html_to_text("raw"))
    found = texts.withColumn("s", speakers.voice_title(F.when(F.col("layout") == 3, speakers.leading_title("raw")).otherwise(F.col("title")))).withColumn("content", speakers.without_header("raw"))
    found = found.filter("content <> ''").withColumn("first", F.min("layout").over(Window.partitionBy(key))).filter("layout = first")
    rows = found.select(key, "position", F.col("s.role").alias("speaker_role"), F.col("s.name").alias("speaker_name"), "content")
    return finished(rows, key, ["position"], classify.utterance_kind("speaker_role"))


def links_with_dates(pages: DataFrame, key: str = "page_id", html: str = "html", window: int = 300) -> DataFrame:
    """key, pos, href, label and held_on of a page's links: the first ISO date, else the first date in years, months and days, among the characters after a link."""
    link = f"(?is)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>(?=(.{{0,{window}}}))"
    href, label, after = [F.regexp_extract_all(html, F.lit(link), F.lit(i)) for i in (1, 2, 3)]
    rows = pages.select(key, F.posexplode(F.arrays_zip(href.alias("href"), label.alias("label"), after.alias("after"))).alias("pos", "x"))
    return rows.select(key, "pos", "x.href", text.squeeze(F.regexp_replace("x.label", "<[^>]+>", "")).alias("label"), dates.listed_date("x.after").alias("held_on"))


# gijiroku_com

_ANCHOR = "(?i)<A\\s+NAME=\"HUID\\d+\">\\s*</A>"


def _parsed(rows: DataFrame, key: str, piece: Column) -> DataFrame:
    """Utterances of pieces in order of (key, position): their markers tell them from headings and rosters."""
    rows = rows.withColumn("plain", text.html_to_text(F.regexp_replace(piece, "(?i)<P>", "<br>")))
    rows = rows.filter(~F.col("plain").rlike("^[△(（]")).withColumn("u", speakers.anchored_utterance("plain")).filter("u is not null")
    rows = rows.select(key, "position", F.col("u.role").alias("speaker_role"), F.col("u.name").alias("speaker_name"), "u.content", "u.marker")
    return finished(rows, key, ["position"], classify.utterance_kind_marked(F.col("speaker_role"), F.col("marker")))


def gijiroku_page_utterances(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Utterances of pages that hold a whole meeting, an anchor before each."""
    return _parsed(pages.select(key, F.posexplode(F.split(html, _ANCHOR)).alias("position", "piece")).filter("position > 0"), key, F.col("piece"))


def gijiroku_utterances(sidebars: DataFrame, pages: DataFrame, key: str = "meeting", html: str = "html", huid: str = "huid") -> DataFrame:
    """Utterances of meetings whose sidebar (key, html) lists them and whose pages (key, huid, html) have landed.

    position is the place in the sidebar, where rosters and headings are passed over; a page that has not landed, or holds
    no utterance, leaves a gap. Offsets run on over the pages. Of a page that landed twice the first text in order counts.
    """
    entry = "(?i)<A\\s+NAME=\"(\\d+)\">\\s*</A>.*?<B>([^<]+)</B>"
    ids, labels = [F.regexp_extract_all(html, F.lit(entry), F.lit(i)) for i in (1, 2)]
    listed = sidebars.select(key, F.posexplode(F.arrays_zip(ids.alias("id"), labels.alias("label"))).alias("position", "x"))
    listed = listed.select(key, "position", F.col("x.id").alias(huid), text.trim_all("x.label").alias("label")).filter(~((F.col("label") == "(名簿)") | F.col("label").startswith("△")))
    landed = pages.groupBy(key, huid).agg(F.min(html).alias("_html"))
    after = F.get(F.split("_html", _ANCHOR, 2), F.lit(1))
    return _parsed(listed.join(landed, [key, huid]), key, F.split(after, "(?i)<(?:FORM|SCRIPT|/BODY)", 2)[0])


# kensakusystem

#: Levels of tabs below the tree's first page.
LEVELS = 3


def _tabs(opened: DataFrame) -> DataFrame:
    """The tabs of opened pages, each once a page at its first place."""
    tabs = opened.select("site", "place", "scope", F.posexplode(F.array_distinct(F.regexp_extract_all("html", F.lit("treedepth\\.value\\s*=\\s*'([^']+)'"), F.lit(1)))).alias("at", "node"))
    return tabs.select("site", F.concat("place", F.array("at")).alias("place"), "scope", "node")


def _meetings(opened: DataFrame, named: bool) -> DataFrame:
    """The meetings that opened pages link to: held_on follows from the file's name."""
    href = "(?i)href=[\"']([^\"']*ResultFrame\\.exe[^\"']*)[\"']"
    rows = opened.select("site", "place", "node", F.posexplode(F.regexp_extract_all("html", F.lit(href), F.lit(1))).alias("at", "href"))
    rows = rows.withColumn("href", F.regexp_replace("href", "(?i)&amp;", "&")).withColumn("file", F.regexp_extract("href", "(?i)[?&]fileName=([^&]+)", 1))
    rows = rows.withColumn("held_on", dates.filename_date("file")).filter("held_on is not null")
    day = F.col("held_on").cast("string")
    return rows.select("site", F.concat("place", F.array(F.lit(-1), "at")).alias("place"), F.concat_ws(" ", text.trim_all("node"), day).alias("title") if named else day.alias("title"), "held_on", "href", "file")


def tree_meetings(pages: DataFrame, year: int | None = None) -> DataFrame:
    """site, title, held_on, href, file of the meetings that a tree of landed pages leads to, each address of a site once, at its first place.

    pages: (site, node, html); node is the tab that a page answers to, null for a site's first page. Each level joins the
    frontier's tabs with the pages and leaves out tabs that stand on the levels above: those of the first page and, further
    down, those of the same first tab. Below the second level only pages without meetings are followed. year: only first tabs
    that may hold it (a tab is named after one of the years that it covers).
    """
    pages = pages.groupBy("site", "node").agg(F.min("html").alias("html"))
    top = pages.filter("node is null").select("site", F.array().cast("array<int>").alias("place"), F.lit(None).cast("string").alias("scope"), "html")
    first = _tabs(top)
    labelled = F.when(~F.col("node").contains("元"), dates.label_year(F.col("node")))  # a tab named after an era's first year reaches far back
    chosen = first.filter(labelled.isNull() | (F.abs(labelled - year) <= 1)) if year else first
    frontier, found, seen = chosen.withColumn("scope", F.col("node")), None, None
    for level in range(LEVELS):
        opened = frontier.join(pages.filter("node is not null"), ["site", "node"])
        here = _meetings(opened, named=level > 0)
        found = here if found is None else found.unionByName(here)
        if level + 1 == LEVELS:
            break
        follow = opened if level == 0 else opened.join(here.select("site", F.slice("place", 1, level + 1).alias("place")).distinct(), ["site", "place"], "left_anti")
        new = _tabs(follow).join(first.select("site", "node"), ["site", "node"], "left_anti")
        new = new if seen is None else new.join(seen, ["site", "scope", "node"], "left_anti")
        seen = frontier.select("site", "scope", "node").unionByName(new.select("site", "scope", "node")).distinct()
        frontier = new
    return first_wins(found, ["site", "href"], [F.col("place")]).select("site", "title", "held_on", "href", "file")


def speakers_frame(html: Column | str) -> Column:
    """The address of the frame that lists the speakers, null without one."""
    return F.nullif(F.regexp_extract(html, "(?i)<frame[^>]*src=[\"']([^\"']*r_Speakers\\.exe[^\"']*)[\"']", 1), F.lit(""))


def speaker_positions(lists: DataFrame, key: str = "meeting", html: str = "html") -> DataFrame:
    """key, place, code, file and position of each turn that a list of speakers offers: by its download form, else by its links; position 0 is the agenda."""
    inputs = F.regexp_extract_all(html, F.lit("(?is)<input[^>]*>"), F.lit(0))
    value = lambda name: F.transform(F.filter(inputs, lambda x: markup.attribute(x, "name") == name), lambda x: markup.attribute(x, "value"))
    given = F.filter(value("downloadPos"), lambda x: x != "")
    links = F.transform(F.regexp_extract_all(html, F.lit("(?i)href=[\"'](?:[^\"']*/)?r_TextFrame\\.exe\\?([^\"']+)[\"']"), F.lit(1)), lambda x: F.split(x, "/"))
    links = F.filter(links, lambda x: F.size(x) >= 3)
    linked = F.filter(F.transform(links, lambda x: x[2]), lambda x: (x != "") & (x != "0"))
    code = F.coalesce(F.nullif(F.get(value("Code"), F.lit(0)), F.lit("")), F.get(links, F.lit(0))[0])
    file = F.coalesce(F.nullif(F.get(value("fileName"), F.lit(0)), F.lit("")), F.get(links, F.lit(0))[1])
    form = F.col(html).rlike("(?is)<form[^>]*name=[\"']download[\"']") & (F.size(given) > 0)
    rows = lists.select(key, code.alias("code"), file.alias("file"), F.posexplode(F.when(form, given).otherwise(linked)).alias("place", "position"))
    return rows.filter("code <> '' and file <> ''")


def assembled_texts(turns: DataFrame, texts: DataFrame, key: str = "meeting") -> DataFrame:
    """key and body: the landed texts (code, file, position, body) of a meeting's turns, in the order of its list of speakers."""
    joined = turns.join(texts, ["code", "file", "position"])
    return joined.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda x: x["body"]), "\n").alias("body"))
