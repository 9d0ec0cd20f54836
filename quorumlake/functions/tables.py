"""Table functions for SQL: links of a page, called laterally, and the utterances of pieces of meetings, called on a table.

    SELECT p.page_id, l.* FROM pages p, LATERAL page_links(p.html, p.url) l
    SELECT * FROM family_utterances(TABLE(SELECT meeting, place, piece FROM pieces), 'gijiroku_com')

A call states its own columns when the query is analysed. family_utterances asks for its rows by meeting and in order of
place; it holds the number and the offset of one meeting's utterances, and streams through the rows.
"""

import re
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType


class _Links(HTMLParser):
    """Links with their text, and the heading that stands before each."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[str, str, str | None]] = []
        self.heading: str | None = None
        self._text: list[str] | None = None
        self._href: str | None = None

    def handle_starttag(self, tag, attrs):
        if re.fullmatch("h[1-6]", tag) or (tag == "a" and dict(attrs).get("href") is not None):
            self._href = dict(attrs).get("href") if tag == "a" else None
            self._text = []

    def handle_data(self, data):
        if self._text is not None:
            self._text.append(data)

    def handle_endtag(self, tag):
        if self._text is None or not re.fullmatch("h[1-6]|a", tag):
            return
        said = " ".join("".join(self._text).split())
        if tag != "a":
            self.heading = said
        elif self._href is not None:
            self.found.append((self._href, said, self.heading))
        self._text = self._href = None


@udtf
class PageLinks:
    """pos, href (resolved against the page's address, if one is given), label and heading of each link of a page."""

    @staticmethod
    def analyze(html: AnalyzeArgument, base: AnalyzeArgument | None = None) -> AnalyzeResult:
        for given in (html, base):
            if given is not None and given.dataType.simpleString() not in ("string", "void"):
                raise ValueError(f"page_links reads text, not {given.dataType.simpleString()}")
        return AnalyzeResult(StructType().add("pos", IntegerType()).add("href", StringType()).add("label", StringType()).add("heading", StringType()))

    def eval(self, html: str | None, base: str | None = None):
        parser = _Links()
        parser.feed(html or "")
        for pos, (href, label, heading) in enumerate(parser.found):
            yield pos, urljoin(base, href) if base else href, label, heading


@dataclass(frozen=True)
class Header:
    """How the pieces of a family begin: the first of its patterns that matches gives marker, role and name; what a piece must not begin with."""

    patterns: tuple[str, ...]
    skip: str = "(?!)"


#: The families' forms of a header, the more precise ones first.
HEADERS = {
    "gijiroku_com": Header((r"(?P<marker>[◎○◯●◆])\s*(?P<role>[^（\n]+?)\s*（(?P<name>[^）]+)）\s*", r"(?P<marker>[◎○◯●◆])\s*(?P<name>\S+)\s+(?P<role>\S+)\s{2,}", r"(?P<marker>[◎○◯●◆])\s*(?P<role>[^\s（]+)\s*"), "[△(（]"),
    "dbsearch": Header((r"(?P<marker>[◯○◎●])(?P<role>[^（\n]+)（(?P<name>[^）]*)）(?:〔[^〕]*〕)?\s*", r"(?P<marker>[◯○◎●])(?P<role>[^（\s]+)\s+")),
}
_HONORIFIC = re.compile("(さん|くん|君)$")


def plain_text(piece: str) -> str:
    """A piece of markup as text: line ends for br and p, no tags, entities decoded."""
    text = unescape(re.sub("<[^>]+>", "", re.sub(r"(?i)<br\s*/?>|</?p\s*>", "\n", piece)))
    return re.sub("\n{3,}", "\n\n", text).strip()


@udtf
class FamilyUtterances:
    """The first column's value, position, place, marker, role, name, content and offsets of the utterances among pieces (meeting, place, piece) of a page family."""

    def __init__(self) -> None:
        self.position = self.offset = 0
        self.header: Header | None = None

    @staticmethod
    def analyze(pieces: AnalyzeArgument, family: AnalyzeArgument) -> AnalyzeResult:
        if not pieces.isTable or len(pieces.dataType.fields) != 3:
            raise ValueError("family_utterances takes a table of meeting, place and piece")
        if not family.isConstantExpression or family.value not in HEADERS:
            raise ValueError(f"no page family {family.value!r}: it is one of {', '.join(HEADERS)}")
        meeting, place, _ = pieces.dataType.fields
        schema = StructType().add(meeting).add("position", IntegerType()).add(place)
        for name in ("marker", "role", "name", "content"):
            schema = schema.add(name, StringType())
        schema = schema.add("start_offset", LongType()).add("end_offset", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(meeting.name)], orderBy=[OrderingColumn(place.name)])

    def eval(self, row, family: str):
        meeting, place, piece = row
        self.header = self.header or HEADERS[family]
        text = plain_text(piece or "")
        found = None if re.match(self.header.skip, text) else next((m for p in self.header.patterns if (m := re.match(p, text))), None)
        content = text[found.end() :].strip() if found else ""
        if not content:
            return
        said = found.groupdict()
        name = re.sub(r"\s+", "", _HONORIFIC.sub("", (said.get("name") or "").strip())) or None
        start = self.offset
        self.offset += len(content) + 1
        yield meeting, self.position, place, said["marker"], said["role"].strip(), name, content, start, start + len(content)
        self.position += 1


def register(spark: SparkSession) -> None:
    """Makes page_links and family_utterances known to the session's SQL."""
    spark.udtf.register("page_links", PageLinks)
    spark.udtf.register("family_utterances", FamilyUtterances)
