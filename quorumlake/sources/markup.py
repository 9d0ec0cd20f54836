"""Markup as a table of events: tags and texts of pages in order, each opening tag with the place of its end.

A page is exploded once; everything else is windows over its events, so that pages spread over tasks and the longest task is
a page's size. Elements may nest, also in elements of their own name; an element that is never closed reaches to the page's end.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements that have no end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Beyond the last event of any page.
PAGE_END = 1 << 30
_TOKEN = "(?s)<!--.*?-->|<[^>]*>|[^<]+|<"


def events(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, token, tag, kind (open, close, single, text or note) and end: where an open element closes; scripts and styles are left out."""
    bare = F.regexp_replace(F.col(html), "(?is)<(script|style)\\b[^>]*>.*?</\\1\\s*>", "")
    # dealt before they are exploded; all windows below keep a page's events together
    rows = pages.select(key, bare.alias("_html")).repartition(F.col(key)).select(key, F.posexplode(F.regexp_extract_all("_html", F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", "^</?([A-Za-z][A-Za-z0-9]*)", 1))
    kind = (
        F.when((F.col("tag") == "") & F.col("token").rlike("^<."), "note").when(F.col("tag") == "", "text").when(F.col("token").startswith("</"), "close")
        .when(F.col("tag").isin(*VOID) | F.col("token").endswith("/>"), "single").otherwise("open")
    )
    rows = rows.withColumn("tag", tag).withColumn("kind", kind)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    depth = F.sum(step).over(Window.partitionBy(key, "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("level", depth + (F.col("kind") == "close").cast("int"))
    # an element ends with the next closing tag of its name and level; seen from the end, that is the last one so far
    after = Window.partitionBy(key, "tag", "level").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    closing = F.last(F.when(F.col("kind") == "close", F.col("pos")), ignorenulls=True).over(after)
    return rows.withColumn("end", F.when(F.col("kind") == "open", F.coalesce(closing, F.lit(PAGE_END)))).drop("level")


def attribute(token: Column | str, name: str) -> Column:
    """A tag's attribute, empty without it."""
    raw = F.regexp_extract(token, f"(?is)[\\s\"']{name}\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s>]+)", 1)
    return F.regexp_replace(raw, "^[\"']|[\"']$", "")


def opens(tag: str, classes: str) -> Column:
    """Whether an event opens an element of that name one of whose classes matches a pattern."""
    return (F.col("kind") == "open") & (F.col("tag") == tag) & attribute("token", "class").rlike(classes)


def latest(key: str, condition: Column, **more: Column) -> Column:
    """(pos, end and more) of the last element so far whose opening event meets a condition."""
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(condition, F.struct("pos", "end", *[v.alias(k) for k, v in more.items()])), ignorenulls=True).over(so_far)


def inside(element: Column, pos: Column | None = None) -> Column:
    """Whether a place lies inside an element given as latest() gives it; not where there is none."""
    pos = F.col("pos") if pos is None else pos
    return F.coalesce((element["pos"] < pos) & (pos < element["end"]), F.lit(False))
