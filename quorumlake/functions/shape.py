"""Shaping of documents: sections under headings, the start of proceedings, pages into one text, links that are minutes."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, _col, _entities, strip_tags, trim_all

#: Fixed value: the words after which proceedings begin.
PROCEEDINGS = f"議{SPACE}*事{SPACE}*の{SPACE}*経{SPACE}*過"
#: What tells a link to a file that is no minutes, and one that is, in its text and in its address.
NO_MINUTES = {"label": ("【表紙】", "【議事日程】"), "href": ("frontcover", "hyoushi", "agenda", "nittei")}
MINUTES = {"label": ("【会議録】", "一般質問", "委員会"), "href": ("minutes", "kaigiroku")}
#: A line that may stand above a page's text is short, no sentence and has no brackets; so many of them go at most.
HEAD_LENGTH, SENTENCE_END, BRACKETS, HEAD_LINES = 16, "[。！？]$", "[「」『』（）()]", 8


def sections(html: Column | str, level: int = 3) -> Column:
    """Array of (heading, body): what stands under each heading of a level, up to the next; what comes before the first is left out."""
    parts = F.slice(F.split(_col(html), f"(?i)(?=<h{level}[\\s>])"), 1, 1_000_000)
    own = F.filter(parts, lambda x: x.rlike(f"(?is)^<h{level}[^>]*>.*?</h{level}>"))
    head = f"(?is)^<h{level}[^>]*>(.*?)</h{level}>"
    return F.transform(own, lambda x: F.struct(strip_tags(F.regexp_extract(x, head, 1)).alias("heading"), F.regexp_replace(x, head, "").alias("body")))


def from_proceedings(c: Column | str) -> Column:
    """The text from the words that open the proceedings; all of it without them."""
    c = _col(c)
    words = F.regexp_extract(c, PROCEEDINGS, 0)
    return F.when(words != "", F.substr(c, F.position(words, c))).otherwise(c)


def page_body(c: Column | str) -> Column:
    """A page's lines, trimmed and none blank, without its number and the lines above its text."""
    lines = F.filter(F.transform(F.split(_col(c), "\n+"), trim_all), lambda x: x != "")
    lines = F.when(F.coalesce(F.get(lines, F.lit(0)), F.lit("")).rlike("^\\d+$"), F.slice(lines, 2, 1_000_000)).otherwise(lines)
    above = lambda x: (F.length(x) <= HEAD_LENGTH) & ~x.rlike(SENTENCE_END) & ~x.rlike(BRACKETS)
    body = F.array_position(F.transform(F.slice(lines, 1, HEAD_LINES), above), F.lit(False))
    gone = F.when(body > 0, body - 1).otherwise(F.least(F.lit(HEAD_LINES), F.size(lines))).cast("int")
    return F.array_join(F.slice(lines, gone + 1, F.greatest(F.lit(0), F.size(lines))), "\n")


def merged_pages(pages: Column | str) -> Column:
    """The bodies of an array of pages, a line each, those without any left out."""
    return F.array_join(F.filter(F.transform(_col(pages), page_body), lambda x: x != ""), "\n")


def decoded_entities(c: Column | str) -> Column:
    """Named entities and decimal references of characters of the basic plane; a reference that is none stays."""
    parts = F.split(_entities(_col(c)), "(?=&#\\d{1,5};)|(?<=&#\\d{1,5};)")
    one = lambda x: F.when(x.rlike("^&#\\d{1,5};$"), _char(F.regexp_extract(x, "^&#(\\d{1,5});$", 1).try_cast("int"))).otherwise(x)
    return F.array_join(F.transform(parts, lambda x: F.coalesce(one(x), x)), "")


def _char(code: Column) -> Column:
    """The character of a code below 65,536, from its two bytes."""
    raw = F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0"))
    return F.when((code > 0) & (code < 65536) & ~code.between(0xD800, 0xDFFF), F.decode(raw, "UTF-16BE"))


def is_minutes_link(label: Column | str, href: Column | str) -> Column:
    """Links to minutes: none of the words of covers and agendas, and a word of minutes, or a numbered name."""
    label, href = F.coalesce(_col(label), F.lit("")), F.coalesce(_col(href), F.lit(""))
    any_of = lambda words: reduce(lambda a, b: a | b, [*[label.contains(w) for w in words["label"]], *[href.contains(w) for w in words["href"]]])
    return ~any_of(NO_MINUTES) & (any_of(MINUTES) | label.rlike("^\\d+\\."))


def base_path(url: Column | str) -> Column:
    """origin and path of the folder that an address lies in, without a trailing slash: up to /voices where that is part of it; null for a host alone. Hosts of the shared service are read by https."""
    u = F.regexp_replace(_col(url), "[?#].*$", "")
    origin = F.lower(F.regexp_extract(u, "^([a-zA-Z]+://[^/]+)", 1))
    origin = F.when(origin.rlike("^[a-z]+://[^/:]*gijiroku\\.com(:|$)"), F.regexp_replace(origin, "^[a-z]+:", "https:")).otherwise(origin)
    path = F.regexp_replace(u, "^[a-zA-Z]+://[^/]+", "")
    voices = F.regexp_extract(path, "(?i)^(.*/voices)/", 1)
    folder = F.regexp_replace(F.regexp_replace(path, "/[^/]*\\.[^/]*$", ""), "/+$", "")
    found = F.when(voices != "", voices).otherwise(folder)
    return F.when((origin != "") & (found != ""), F.struct(origin.alias("origin"), found.alias("base_path")))


def query_url(base: Column | str, path: str, **params: Column) -> Column:
    """base, path and parameters as an address; values are percent-encoded as UTF-8."""
    pairs = [F.concat(F.lit(f"{k}="), F.replace(F.url_encode(v.cast("string")), F.lit("+"), F.lit("%20"))) for k, v in params.items()]
    return F.concat(_col(base), F.lit(path), F.lit("?" if pairs else ""), F.concat_ws("&", *pairs))
