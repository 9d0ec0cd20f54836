"""Landed pages and files: text of encodings, PDF and office files, links with their headings, and utterances by page family.

Fetching pages is not this library's work: pages are read where they have landed, as text or binary files.
"""

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.parse import quote_from_bytes, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, dates, speakers, text
from ..operators.cuts import small_batches
from . import services


def decoded(df: DataFrame, column: str = "content", encoding: str = "cp932", out: str = "body") -> DataFrame:
    """df with the text of a binary column in a named encoding (cp932 for Shift_JIS, euc_jp), what cannot be read replaced."""
    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else bytes(b).decode(encoding, "replace"))

    return df.withColumn(out, decode(column))


def absolute_urls(df: DataFrame, base: str, href: str, out: str = "url") -> DataFrame:
    """Links resolved against their page's address."""

    @F.pandas_udf("string")
    def join(b: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if y is None else urljoin(x or "", y) for x, y in zip(b, h, strict=True)])

    return df.withColumn(out, join(base, href))


def percent_encoded(df: DataFrame, column: str, encoding: str = "cp932", out: str = "encoded") -> DataFrame:
    @F.pandas_udf("string")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else quote_from_bytes(x.encode(encoding, "replace"), safe=""))

    return df.withColumn(out, encode(column))


#: What stands before a tree's place in a page's bytes, and the byte that ends it; the first form that is found holds.
TREE_PLACES = (("document.viewtree.treedepth.value='", "'"), ('data-depth="', '"'))


def percent_bytes(raw: Column | str) -> Column:
    """Every byte of a binary column as %XX."""
    return F.regexp_replace(F.hex(raw), "(..)", "%$1")


def tree_places(raw: Column | str, forms: Sequence[tuple[str, str]] = TREE_PLACES) -> Column:
    """The bytes of a Shift_JIS page between a form's start and its closing byte, percent-encoded, by the first form that gives any.

    Characters of two bytes are passed over whole, so that their second byte closes nothing; empty values are left out.
    """
    c = F.decode(raw, "ISO-8859-1")  # a character for each byte
    lead = "\\x{81}-\\x{9f}\\x{e0}-\\x{fc}"
    found = []
    for start, close in forms:
        value = f"\\Q{start}\\E([^{close}{lead}]*+(?:[{lead}](?s:.)[^{close}{lead}]*+)*+){close}"
        found.append(F.filter(F.regexp_extract_all(c, F.lit(value), F.lit(1)), lambda x: x != ""))
    places = found[-1]
    for f in reversed(found[:-1]):
        places = F.when(F.size(f) > 0, f).otherwise(places)
    return F.transform(places, lambda x: percent_bytes(F.encode(x, "ISO-8859-1")))


def doc_text(raw: bytes) -> str:
    """Printable runs of UTF-16 text in an old office file, a line each."""
    found = re.findall(rb"(?:[\x20-\x7e\r\n\t]\x00|[\x00-\xff][\x30-\x9f\xff]){4,}", raw)
    return "\n".join(x.decode("utf-16-le", "ignore").strip() for x in found)


def pdf_text_layer(raw: bytes) -> str:
    """Strings that a PDF shows with plain operators in uncompressed or deflated streams: what needs no font tables."""
    import zlib

    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", raw, re.S):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        for line in re.finditer(rb"\(((?:[^()\\]|\\.)*)\)\s*Tj|\[((?:[^\]\\]|\\.)*)\]\s*TJ", body):
            parts = [line[1]] if line[1] is not None else re.findall(rb"\(((?:[^()\\]|\\.)*)\)", line[2])
            out.append(b"".join(re.sub(rb"\\([()\\])", rb"\1", p) for p in parts).decode("latin-1"))
    return "\n".join(out)


def is_usable(s: str | None, least: int = 20) -> bool:
    return bool(s) and len(re.sub(r"\s+", "", s)) >= least


def file_text(df: DataFrame, strategies: Sequence[Callable[[bytes], str | None]], column: str = "content", out: str = "body", usable: Callable[[str | None], bool] = is_usable) -> DataFrame:
    """The text of binary files by the first strategy whose text is usable, else by the last that gives any."""

    @F.pandas_udf("string")
    def extract(s: pd.Series) -> pd.Series:
        def one(raw):
            last = None
            for f in strategies if raw is not None else ():
                try:
                    got = f(bytes(raw))
                except Exception:  # noqa: BLE001  a broken file is a file without text
                    continue
                if usable(got):
                    return got
                last = got or last
            return last

        return s.map(one)

    return df.withColumn(out, extract(column))


def texts_side_by_side(df: DataFrame, strategies: dict[str, Callable[[bytes], str | None]], column: str = "content") -> DataFrame:
    """df with a column for each strategy, holding its text of a binary file (null where it fails), all from one pass."""
    names = list(strategies)

    @F.pandas_udf(", ".join(f"{n} string" for n in names))
    def extract(s: pd.Series) -> pd.DataFrame:
        def one(f, raw):
            try:
                return None if raw is None else f(bytes(raw))
            except Exception:  # noqa: BLE001  a broken file is a file without text
                return None

        return pd.DataFrame([[one(f, raw) for f in strategies.values()] for raw in s], columns=names)  # file by file

    return df.withColumn("_texts", extract(column)).select("*", *[F.col(f"_texts.{n}").alias(n) for n in names]).drop("_texts")


def links_in_order(links: DataFrame, page_id: str = "page_id") -> DataFrame:
    """place (from 1) of each link of a page by date, those without one last, then by its place on the page."""
    w = Window.partitionBy(page_id).orderBy(F.asc_nulls_last("held_on"), "pos")
    return links.withColumn("place", F.row_number().over(w))


def dated_links(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Links under the dated heading that stands before them: page_id, pos, heading, href, label, held_on (of the label, else of the heading)."""
    block = "(?is)<h[1-6][^>]*>.*?</h[1-6]>|<a\\s[^>]*?href\\s*=\\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"
    rows = pages.select(page_id, F.posexplode(F.regexp_extract_all(html, F.lit(block), F.lit(0))).alias("pos", "block"))
    w = Window.partitionBy(page_id).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("heading", F.last(F.when(F.col("block").rlike("(?i)^<h[1-6]"), text.strip_tags("block")), ignorenulls=True).over(w))
    links = rows.filter(F.col("block").rlike("(?i)^<a")).withColumn("a", text.anchors("block")[0])
    held = F.coalesce(dates.estimated_date("a.label"), dates.estimated_date("heading"))
    return links.select(page_id, "pos", "heading", "a.href", "a.label", held.alias("held_on"))


def first_links(links: DataFrame, page_id: str = "page_id") -> DataFrame:
    """The first link to each address of a page."""
    from ..operators.clean import first_wins

    return first_wins(links, [page_id, "href"], [F.col("pos")])


@dataclass(frozen=True)
class Family:
    """How one kind of page is read: a row of a table, not a module."""

    name: str
    meeting_type: str = "committee_first"
    #: marked: text split before markers; events: elements of three generations of markup; anchors: markup split at anchors; json: rows of (code, title, body)
    blocks: str = "marked"
    kind: str = "tree"
    hash_prefix: bool = False
    squeeze: bool = True


#: The page families that many councils share, and the generic one for single sites.
FAMILIES = {
    "dbsearch": Family("dbsearch", "committee_first", "events", "plain"),
    "discussnet_ssp": Family("discussnet_ssp", "committee_first", "json", "code", hash_prefix=True),
    "gijiroku_com": Family("gijiroku_com", "committee_first", "anchors", "marked"),
    "kensakusystem": Family("kensakusystem", "committee_first_strict"),
    "custom": Family("custom", "committee_first_strict", kind="tree"),
}


def utterances(pages: DataFrame, family: Family, key: str = "page_id", body: str = "body") -> DataFrame:
    """Utterances of pages of one family: key, position, kind, speaker_name, speaker_role, content, content_hash, start_offset, end_offset.

    body: plain text for families split at markers, markup for those of events and anchors, a JSON array of {code, title, body}
    for the JSON family. Blocks without content go, and so do rows of the JSON family that are no utterances.
    """
    if family.blocks == "events":
        return services.dbsearch_utterances(pages, key, body)
    if family.blocks == "anchors":
        return services.gijiroku_page_utterances(pages, key, body)
    if family.blocks == "marked":
        rows = pages.select(key, F.posexplode(text.split_before(F.col(body))).alias("position", "block")).withColumn("block", text.trim_all("block"))
        rows = rows.filter(F.col("block").rlike(f"^[{text.MARKERS}]"))
        rows = rows.withColumn("u", speakers.utterance(F.regexp_replace("block", f"{text.SPACE}+", " ") if family.squeeze else F.col("block")))
        rows = rows.select(key, "position", F.col("u.role").alias("speaker_role"), F.col("u.name").alias("speaker_name"), F.col("u.content").alias("content"))
        kind = classify.utterance_kind_tree("speaker_role")
    else:
        rows = pages.select(key, F.posexplode(F.from_json(body, "array<struct<code:int,title:string,body:string>>")).alias("position", "z"))
        rows = rows.withColumn("s", speakers.schedule_title("z.title"))
        said = text.strip_tags("z.body")
        said = text.trim_all(F.when(F.startswith(said, F.col("z.title")), F.substring(said, F.length("z.title") + 1, F.length(said))).otherwise(said))
        rows = rows.select(key, "position", F.col("s.role").alias("speaker_role"), F.col("s.name").alias("speaker_name"), said.alias("content"), F.col("z.code").alias("code"))
        kind = classify.kind_by_code("code")
    prefix = F.concat_ws(":", F.col(key).cast("string"), F.col("position").cast("string")) if family.hash_prefix else None
    return services.finished(rows, key, ["position"], kind, prefix)


def lines_to_utterances(pages: DataFrame, key: str = "page_id", body: str = "body") -> DataFrame:
    """Extracted text by lines: noise lines go, a line that begins with a marker opens an utterance, others belong to the one above."""
    from ..operators.chunk import carry_speaker

    rows = pages.select(key, F.posexplode(F.split(text.pdf_lines(body), "\n")).alias("line_no", "line")).filter(~text.is_noise_line("line"))
    head = F.when(F.col("line").rlike(f"^[{text.MARKERS}]"), F.col("line"))
    blocks = carry_speaker(rows, key, ["line_no"], head).groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("body"))
    joined = blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "body"))), lambda x: x["body"]), "\n").alias("body"))
    return utterances(joined, FAMILIES["custom"], key, "body")


def drop_contents_table(body: Column, markers: str = text.MARKERS) -> Column:
    """The text from the first marked block that has no leader dots."""
    parts = text.split_before(body, markers)
    first = F.array_min(F.filter(F.transform(parts, lambda x, i: F.when(x.rlike(f"^[{markers}]") & ~x.rlike("[.．・…]{4,}"), i)), lambda i: i.isNotNull()))
    return F.when(first.isNotNull(), F.array_join(F.slice(parts, first + 1, F.size(parts)), "")).otherwise(body)


def council_tree(df: DataFrame, body: str = "body", year: int | None = None) -> DataFrame:
    """Councils of the JSON family's nested list (groups, years, types, councils), of one year if asked."""
    schema = "array<struct<name:string,years:array<struct<year:string,types:array<struct<name:string,councils:array<struct<council_id:int,name:string>>>>>>>>"
    g = df.select(F.explode(F.from_json(body, schema)).alias("g"))
    y = g.select(F.col("g.name").alias("group"), F.explode("g.years").alias("y"))
    y = y.filter(F.col("y.year") == str(year)) if year else y
    t = y.select("group", F.col("y.year").alias("year"), F.explode("y.types").alias("t"))
    return t.select("group", "year", F.col("t.name").alias("type"), F.inline("t.councils"))


def schedules(df: DataFrame, body: str = "body") -> DataFrame:
    """Schedules of councils, without annexes; councils with none are left out."""
    rows = df.select(F.explode(F.from_json(body, "array<struct<council_id:int,schedules:array<struct<schedule_id:int,name:string>>>>")).alias("c"))
    return rows.select("c.council_id", F.inline("c.schedules")).filter(~F.col("name").contains("別冊"))
