"""Personal data (operator 13): patterns propose spans, checksums confirm them, words nearby raise or lower their score.

A rule is a row of RULES. Its pattern proposes spans, leftmost first and without overlap; what its check refuses is dropped,
and not looked for again inside. The score is the rule's own, with its boost if one of its words stands in the window around
the span, and less its malus if one of its other words does. Spans of base rules stay whatever their score; others need
THRESHOLD, no letter or digit next to them, and no overlap with a base span or one that an earlier rule has accepted.

* email, ip, card (Luhn), phone with a country code: base rules.
* iban: country, length and modulo 97; card with other separators (Luhn), ssn and phone without a country code: only near words
  that name such a thing.

Patterns are searched in time that grows with the text alone: where a pattern may start anywhere in a run of characters, the
run is taken whole and the rest of the pattern tried once, at its end.

Defined results: a null or empty text has no spans. Places are code points, the end exclusive. A text of any length is
searched whole; each row is judged by itself, so repeated rows and equal doc_ids do not matter. An empty table gives no rows;
further columns do not matter, those named in extra are passed on.
"""

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small_batches
from .textkernel import steps

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: Score, in hundredths, that a span of a rule other than the base ones needs.
THRESHOLD = 60
#: Code points before and after a span in which words count.
BEFORE, AFTER = 50, 25
#: Lengths of IBANs and the countries that have them, as registered.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
IBAN = "|".join(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{length - 4}}}" for length, countries in IBAN_COUNTRIES.items())

_NOT_DIGITS = re.compile("[^0-9]")


def digits(s: str) -> str:
    return _NOT_DIGITS.sub("", s)


def luhn(number: str) -> bool:
    """Whether the digits from the right, every second one doubled, sum to a multiple of ten."""
    odd, even = number[-1::-2], number[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def mod_97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(x, 36)) for x in s[4:] + s[:4])) % 97 == 1


def is_address(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))


def is_card(s: str) -> bool:
    return 12 <= len(s) - s.count(" ") - s.count("-") <= 19 and luhn(digits(s))


def is_any_card(s: str) -> bool:
    return 12 <= len(number := digits(s)) <= 19 and luhn(number)


def is_phone(s: str) -> bool:
    return 9 <= len(digits(s)) <= 15


def is_local_phone(s: str) -> bool:
    return 7 <= len(digits(s)) <= 12


def is_ssn(s: str) -> bool:
    area, group, serial = s.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _whole(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    """Spans of a pattern none of whose attempts reads far in vain."""
    find = re.compile(pattern).finditer
    return lambda text: (m.span() for m in find(text))


def _after_run(run: str, rest: str, needs: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    """Spans of a run of characters followed by rest: a run is taken whole, so that rest is tried once for each; needs: a character of all spans."""
    find = re.compile(f"{run}++({rest})?").finditer
    return lambda text: (m.span() for m in find(text) if m.group(1)) if needs in text else iter(())


def _from_starts(start: str, pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    """Spans of a pattern, tried only at the places of its own start."""
    find, match = re.compile(start).finditer, re.compile(pattern).match

    def spans(text: str) -> Iterator[tuple[int, int]]:
        end = 0
        for s in find(text):
            if s.start() >= end and (m := match(text, s.start())):
                end = m.end()
                yield m.span()

    return spans


@dataclass(frozen=True)
class Rule:
    """words, against: alternatives of a pattern over ASCII lower case, which count between characters that are no ASCII letters."""

    kind: str
    spans: Callable[[str], Iterator[tuple[int, int]]]
    check: Callable[[str], bool]
    base: bool
    score: int
    words: str
    boost: int
    against: str = ""
    malus: int = 0


CARD_WORDS = "card|cards|visa|mastercard|amex|credit|debit|carte|karte|kreditkarte|tarjeta"
PHONE_WORDS = "phone|telephone|tel|telefon|telefono|mobile|mobil|movil|cell|call|fax|handy|anruf|appel"
RULES = (
    Rule("email", _after_run("[A-Za-z0-9._%+-]", r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"), lambda s: True, True, 90, "mail|email|contact|write|kontakt|correo", 10),
    Rule("ip", _after_run("[0-9]", r"(?:\.[0-9]++){3}", "."), is_address, True, 70, "ip|host|server|addr|address|client", 20, "version|release|section|chapter", 40),
    Rule("card", _whole("[0-9](?:[ -]?[0-9])++"), is_card, True, 80, CARD_WORDS, 20),
    Rule("phone", _whole(r"\+[0-9][ ().0-9-]+[0-9]"), is_phone, True, 80, PHONE_WORDS, 20),
    Rule("iban", _from_starts("[A-Z]{2}[0-9]{2}", IBAN), mod_97, False, 70, "iban|bank|account|konto|compte|cuenta|bic|swift", 30),
    Rule("card", _whole("[0-9](?:[ ._/-]{0,2}[0-9])++"), is_any_card, False, 30, CARD_WORDS, 50),
    Rule("ssn", _whole("[0-9]{3}-[0-9]{2}-[0-9]{4}"), is_ssn, False, 40, "ssn|social security|security number", 50),
    Rule("phone", _whole(r"[(]?[0-9]{2,5}[)]?(?:[ ./-]{1,2}[0-9]{2,5}){1,4}"), is_local_phone, False, 30, PHONE_WORDS, 40),
)

_WORDS = [tuple(re.compile(f"(?:^|[^a-z])(?:{x})(?:[^a-z]|$)") if x else None for x in (r.words, r.against)) for r in RULES]
_ALNUM = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DIGIT = re.compile("[0-9]")


def _window(text: str, start: int, end: int) -> str:
    """What stands around a span, in ASCII lower case; the span itself is a bar."""
    return (text[max(0, start - BEFORE) : start] + "|" + text[end : end + AFTER]).encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def personal_spans(text: str) -> list[tuple[str, int, int, int, bool]]:
    """(kind, start, end, score, base) of a text's spans, by start, then in the order of KINDS."""
    out: list[tuple[str, int, int, int, bool]] = []
    any_digit = _DIGIT.search(text)
    taken: list[tuple[int, int]] = []
    for rule, (words, against) in zip(RULES, _WORDS, strict=True):
        if not any_digit and rule.kind != "email":
            continue
        accepted = []
        for start, end in rule.spans(text):
            if not rule.check(text[start:end]):
                continue
            if not rule.base and ((start and text[start - 1] in _ALNUM) or (end < len(text) and text[end] in _ALNUM)):
                continue
            around = _window(text, start, end)
            score = rule.score + (rule.boost if words.search(around) else 0) - (rule.malus if against and against.search(around) else 0)
            if rule.base or score >= THRESHOLD:
                accepted.append((start, end))
                if rule.base or not _overlaps(taken, start, end):
                    out.append((rule.kind, start, end, score, rule.base))
        taken = _merged([*taken, *accepted]) if accepted else taken
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[1], order[x[0]], x[2]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as spans that do not overlap, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span shares a place with one of taken, which are in order and apart."""
    i = bisect_left(taken, (end,))
    return i > 0 and taken[i - 1][1] > start


def redacted(text: str, spans: list[tuple[str, int, int, int, bool]]) -> str:
    """The text with each run of spans replaced by the kind of its first one in square brackets."""
    out, done = [], 0
    for kind, start, end, *_ in spans:
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


SPANS = "array<struct<kind:string,start:int,end:int,score:int,base:boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.int32()), ("base", pa.bool_())]))


def find_personal(docs: DataFrame, texts: bool = True, extra: list[str] | None = None) -> DataFrame:
    """doc_id, spans (SPANS) and, if texts is true, the redacted text of each row of docs, and its columns named in extra."""
    small_batches(docs.sparkSession)
    extra = extra or []
    names = [f"_x{i}" for i in range(len(extra))]

    def search(batches):
        for batch in batches:
            for t in steps(batch.column("text")):
                cut = batch.slice(t.rows.start, t.count)
                read = [x or "" for x in cut.column("text").to_pylist()]
                found = [personal_spans(x) for x in read]
                items = [[dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in spans] for spans in found]
                clean = pa.array([redacted(x, s) for x, s in zip(read, found, strict=True)] if texts else [None] * t.count, pa.string())
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), pa.array(items, _SPANS), clean, *[cut.column(x) for x in names]], names=["doc_id", "spans", "redacted", *names])

    schema = f"doc_id long, spans {SPANS}, redacted string" + "".join(f", {n} {docs.schema[x].dataType.simpleString()}" for n, x in zip(names, extra, strict=True))
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(x).alias(n) for n, x in zip(names, extra, strict=True)])
    found = taken.mapInArrow(search, schema)
    return found.select("doc_id", "spans", *(["redacted"] if texts else []), *[F.col(n).alias(x) for n, x in zip(names, extra, strict=True)])


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Numbers and hash of the base spans, and all spans, of what find_personal returns."""
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
