"""String functions on columns: whitespace, digits, markup, hashes, hosts and links."""

import math
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space as ECMAScript has it, which includes U+3000.
SPACE = "[\\s\\x0B\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: What of it is not ASCII.
RARE_SPACE = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Digits in both widths.
FULL_DIGITS, HALF_DIGITS = "０１２３４５６７８９", "0123456789"
#: Marks that stand before an utterance.
MARKERS = "○◯◎●"
#: Domains that many councils share.
SHARED_DOMAINS = ("dbsr.jp", "kaigiroku.net", "kensakusystem.jp", "gijiroku.com")
CJK = "\\u3040-\\u30ff\\u3400-\\u9fff\\uf900-\\ufaff々〆ヵヶ"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c: Column | str) -> Column:
    """Without white space, U+3000 included, at both ends."""
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+$", "")


def _plain_space(c: Column | str) -> Column:
    """Rare kinds of white space as spaces, so that the patterns that follow see ASCII ones only."""
    return F.translate(_col(c), RARE_SPACE, " " * len(RARE_SPACE))


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_plain_space(c), "\\s+", " "))


def tokens(c: Column | str) -> Column:
    """Search tokens: split at white space, none empty. An all-blank text has none."""
    return F.filter(F.split(_plain_space(c), "\\s+"), lambda x: x != "")


def half_width_digits(c: Column | str) -> Column:
    return F.translate(_col(c), FULL_DIGITS, HALF_DIGITS)


def full_width_digits(c: Column | str) -> Column:
    return F.translate(_col(c), HALF_DIGITS, FULL_DIGITS)


def normalise(c: Column | str) -> Column:
    """Half-width digits, ideographic spaces as spaces, large circles as the plain circle."""
    return F.translate(_col(c), FULL_DIGITS + "　◯〇", HALF_DIGITS + " ○○")


def length_utf16(c: Column | str) -> Column:
    """Length in UTF-16 units, as ECMAScript counts; length() counts code points."""
    return (F.octet_length(F.encode(_col(c), "UTF-16BE")) / 2).cast("int")


def left(c: Column | str, n: int) -> Column:
    return F.substring(_col(c), 1, n)


def despace_cjk(c: Column | str) -> Column:
    """No spaces between CJK characters: one pass with look-around reaches the fixpoint of repeated removal."""
    return F.regexp_replace(_col(c), f"(?<=[{CJK}])[ 　]+(?=[{CJK}])", "")


def _entities(c: Column) -> Column:
    # the ampersand last, so that nothing is decoded twice
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def html_to_text(c: Column | str) -> Column:
    """Line breaks for br and p ends, no tags, named entities decoded, at most one empty line in a row."""
    c = F.regexp_replace(_col(c), "(?i)<br\\s*/?>|</p\\s*>", "\n")
    c = _entities(F.regexp_replace(c, "<[^>]+>", ""))
    return trim_all(F.regexp_replace(c, "\n{3,}", "\n\n"))


def strip_html(c: Column | str) -> Column:
    """Text without script and style blocks and without tags, entities decoded."""
    c = F.regexp_replace(_col(c), "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    return _entities(F.regexp_replace(c, "<[^>]+>", ""))


def strip_tags(c: Column | str) -> Column:
    return trim_all(F.regexp_replace(_col(c), "<[^>]+>", ""))


def anchors(c: Column | str) -> Column:
    """Array of (href, text) of the links of a page, in order."""
    pattern = "(?is)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    found = [F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(i)) for i in (1, 2)]
    return F.transform(F.arrays_zip(found[0].alias("href"), found[1].alias("label")), lambda x: F.struct(x["href"].alias("href"), squeeze(_entities(F.regexp_replace(x["label"], "<[^>]+>", ""))).alias("label")))


def text_before(c: Column | str, marker: str, n: int = 500) -> Column:
    """Up to n characters before the first occurrence of marker, null without one."""
    at = F.instr(_col(c), marker)
    return F.when(at > 0, F.substring(_col(c), F.greatest(F.lit(1), at - n), F.least(at - 1, F.lit(n))))


def split_before(c: Column | str, markers: str = MARKERS) -> Column:
    """Parts of a text, each of which but the first begins with a marker."""
    return F.split(_col(c), f"(?=[{markers}])")


def pdf_lines(c: Column | str) -> Column:
    """Extracted text by lines: form feeds and carriage returns as line ends, spaces squeezed, at most one empty line in a row."""
    lines = F.split(F.regexp_replace(_col(c), "\\f|\\r\\n?", "\n"), "\n")
    clean = F.transform(lines, lambda x: F.trim(F.regexp_replace(despace_cjk(half_width_digits(x)), "[ \\t]+", " ")))
    return F.regexp_replace(F.array_join(clean, "\n"), "\n{3,}", "\n\n")


def is_noise_line(c: Column | str) -> Column:
    """Empty lines, page numbers, separators and stage directions in brackets."""
    c = _col(c)
    number, separator = "^[―─－−\\-\\s]*\\d+[\\s―─－−\\-]*$", f"^[―─－−\\- ]*[{MARKERS}][―─－−\\- ]*$"
    direction = "^[（(].*?(?:呼ぶ者あり|起立者あり|拍手|休憩|登壇|退席|着席).*?[）)]$"
    return (c == "") | c.rlike(number) | c.rlike(separator) | c.rlike(direction)


def content_hash(c: Column | str, prefix: Column | str | None = None) -> Column:
    """SHA-256 in hex; one page family hashes its minute id before the text."""
    c = _col(c)
    return F.sha2(c if prefix is None else F.concat(_col(prefix), c), 256)


def short_id(c: Column | str) -> Column:
    return F.substring(F.md5(_col(c)), 1, 12)


def composite_id(system: str, *parts: Column | str) -> Column:
    """system_part_part, null if a part is missing or empty."""
    parts = [_col(p).cast("string") for p in parts]
    missing = F.lit(False)
    for p in parts:
        missing = missing | p.isNull() | (p == "")
    return F.when(~missing, F.concat_ws("_", F.lit(system), *parts))


def host(*urls: Column | str) -> Column:
    """Host of the first URL that has one, else 'unknown'."""
    return F.coalesce(*[F.lower(F.try_parse_url(_col(u), F.lit("HOST"))) for u in urls], F.lit("unknown"))


def group_key(hostname: Column | str) -> Column:
    """A shared service's domain for hosts under it, else the host."""
    h = _col(hostname)
    last = F.array_join(F.slice(F.split(h, "\\."), -2, 2), ".")
    return F.when((F.size(F.split(h, "\\.")) > 2) & last.isin(*SHARED_DOMAINS), last).otherwise(h)


def adapter_key(url: Column | str, code: Column | str) -> Column:
    """The page family that a URL belongs to; the first rule that holds wins, else the council's code."""
    u = _col(url)
    return (
        F.when(u.contains("ssp.kaigiroku.net") | u.rlike("/tenant/[^/]+/"), "discussnet_ssp")
        .when(u.contains("dbsr.jp"), "dbsearch")
        .when(u.contains("kensakusystem.jp") & ~u.contains("-vod/"), "kensakusystem")
        .when(u.contains("gijiroku.com") | u.rlike("(?i)/VOICES/") | u.rlike("(?i)g0[78]v_search\\.asp"), "gijiroku_com")
        .otherwise(_col(code))
    )


def contains_folded(a: Column | str, b: Column | str) -> Column:
    return F.contains(F.lower(_col(a)), F.lower(_col(b)))


def timestamp_label(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyyMMdd-HHmmss")


#: The forms in which services say how long to wait, and their unit in milliseconds; the first that is found holds.
RETRY_FORMS = (('"retryDelay"\\s*:\\s*"([0-9.]+)s"', 1000), ("Please retry in ([0-9.]+)ms", 1), ("Please retry in ([0-9.]+)s", 1000))


def retry_delay_ms(c: Column | str) -> Column:
    """Milliseconds, rounded up, that an error message asks to wait, null without any."""
    c = _col(c)
    return F.coalesce(*[F.when(c.rlike(p), F.ceil(F.regexp_extract(c, p, 1).try_cast("decimal(20,9)") * scale)) for p, scale in RETRY_FORMS]).cast("long")


def retry_delay_ms_of(message: str) -> int | None:
    """retry_delay_ms of one message, for what calls a service."""
    found = next(((m[1], scale) for p, scale in RETRY_FORMS if (m := re.search(p, message))), None)
    return None if found is None else math.ceil(Decimal(found[0]) * found[1])


def tenant_id(c: Column | str) -> Column:
    """The tenant's number in a service's script: as it is assigned, else the last one of a hidden field; fields in comments come before."""
    c = _col(c)
    fields = F.regexp_extract_all(c, F.lit("tenant_id[\"']\\s+value=[\"'](\\d+)[\"']"), F.lit(1))
    return F.coalesce(F.nullif(F.regexp_extract(c, "tenant_id\\s*=\\s*(\\d+)", 1), F.lit("")), F.try_element_at(fields, F.lit(-1))).try_cast("int")


def jsonp_body(c: Column | str) -> Column:
    """The JSON inside callback(…); the text itself if it is not wrapped."""
    inner = F.regexp_extract(_col(c), "(?s)^\\s*[\\w$.]+\\s*\\((.*)\\)\\s*;?\\s*$", 1)
    return F.when(inner != "", inner).otherwise(_col(c))


def like_pattern(text: str) -> str:
    """%text% for a LIKE that has no error cases: a backslash before an ordinary character is dropped, as PostgreSQL reads it."""
    out, i = [], 0
    while i < len(text):
        if text[i] == "\\":
            following = text[i + 1] if i + 1 < len(text) else ""
            out.append("\\" + following if following in ("%", "_", "\\") and following else following)
            i += 2
        else:
            out.append(text[i])
            i += 1
    return "%" + "".join(out) + "%"
