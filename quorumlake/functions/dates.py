"""Dates as Japanese minutes write them: eras, kanji numerals, file names. Results are ISO strings, not validated; use valid_date for that."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, half_width_digits

#: Eras and the year before their first.
ERAS = (("令和", 2018), ("平成", 1988), ("昭和", 1925))
ERA_LETTERS = (("R", 2018), ("H", 1988), ("S", 1925))
KANJI = "〇一二三四五六七八九"


def _found(c: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), _two(month), F.lit("-"), _two(day))


def _two(c: Column) -> Column:
    c = c.cast("string")
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def era_year(era: Column | str, year: Column | str) -> Column:
    """Gregorian year; the first year may be written 元."""
    n = F.when(_col(year) == "元", 1).otherwise(half_width_digits(_col(year)).try_cast("int"))
    out = F.lit(None).cast("int")
    for name, base in reversed(ERAS):
        out = F.when(_col(era) == name, n + base).otherwise(out)
    return out


def kanji_number(c: Column | str) -> Column:
    """Kanji numerals under one hundred: a fold over characters in which ten multiplies what stands before it."""
    chars = F.filter(F.split(_col(c), ""), lambda x: x != "")
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("now"))
    places = F.create_map(*[F.lit(x) for i, k in enumerate(KANJI) for x in (k, i)])
    return F.aggregate(chars, start, lambda a, x: F.struct(
        (a["sum"] + F.when(x == "十", F.when(a["now"] == 0, 10).otherwise(a["now"] * 10)).otherwise(0)).alias("sum"),
        F.when(x == "十", 0).otherwise(F.coalesce(F.try_element_at(places, x), a["now"])).alias("now"),
    ), lambda a: a["sum"] + a["now"])


def era_date(c: Column | str) -> Column:
    """Era date or western date of a text; eras are tried in order."""
    c = half_width_digits(_col(c))
    tries = []
    for era, base in ERAS:
        p = f"{era}(\\d+|元)年(\\d{{1,2}})月(\\d{{1,2}})日"
        tries.append(F.when(c.rlike(p), _iso(era_year(F.lit(era), F.regexp_extract(c, p, 1)), F.regexp_extract(c, p, 2), F.regexp_extract(c, p, 3))))
    return F.coalesce(*tries, western_date(c))


def western_date(c: Column | str) -> Column:
    p = "(\\d{4})[.\\-/年](\\d{1,2})[.\\-/月](\\d{1,2})"
    c = _col(c)
    return F.when(c.rlike(p), _iso(*[F.regexp_extract(c, p, i) for i in (1, 2, 3)]))


def listed_date(c: Column | str) -> Column:
    """The first ISO date of a text, else its first date in years, months and days."""
    c, p = _col(c), "(\\d{4})年(\\d{1,2})月(\\d{1,2})日"
    return F.coalesce(_found(c, "(\\d{4}-\\d{2}-\\d{2})", 1), F.when(c.rlike(p), _iso(*[F.regexp_extract(c, p, i) for i in (1, 2, 3)])))


def sitting_date(c: Column | str) -> Column:
    """The date of a sitting in a list of members, by seven rules of falling precision; the first that finds one wins.

    Era digits; western year before an era in brackets; western year in brackets; kanji numerals; an era year here and month
    and day there; the same with kanji month and day; any western date.
    """
    c = half_width_digits(F.regexp_replace(F.regexp_replace(_col(c), "<[^>]+>", ""), "(?i)&[a-z]+;", " "))
    # the text is made once, and bound; each rule's pattern runs once to find its match, whose parts are then taken from it
    return F.element_at(F.transform(F.array(c), _sitting_rules), 1)


def _sitting_rules(c: Column) -> Column:
    day, kanji_day, none = "(\\d{1,2})月(\\d{1,2})日", f"([{KANJI}十]+)月([{KANJI}十]+)日", F.lit(None).cast("string")

    def first(pattern: str, made, era: str | None = None) -> Column:
        """made(parts) of the first match; texts without the era's name are passed over at once."""
        parts = F.transform(F.filter(F.array(F.regexp_extract(c, pattern, 0)), lambda m: m != ""), lambda m: made(lambda i: F.regexp_extract(m, pattern, i)))
        found = F.get(parts, F.lit(0))
        return found if era is None else F.when(c.contains(era), found).otherwise(none)

    tries: list[Column] = []
    for era, base in ERAS:
        tries.append(first(f"{era}\\s*(\\d+)年\\s*(\\d{{1,2}})月\\s*(\\d{{1,2}})日", lambda g, base=base: _iso(g(1).try_cast("int") + base, g(2), g(3)), era))
    for p in (f"(\\d{{4}})年\\s*[（(][^）)]+[）)]\\s*{day}", f"[（(](\\d{{4}})年[）)]\\s*{day}"):
        tries.append(first(p, lambda g: _iso(g(1), g(2), g(3))))
    for era, base in ERAS:
        tries.append(first(f"{era}([{KANJI}十]+)年([{KANJI}十]+)月([{KANJI}十]+)日", lambda g, base=base: _iso(kanji_number(g(1)) + base, kanji_number(g(2)), kanji_number(g(3))), era))
    for era, base in ERAS:
        year = first(f"{era}\\s*(\\d+)年", lambda g, base=base: (g(1).try_cast("int") + base).cast("string"), era)
        tries.append(first(day, lambda g, year=year: _iso(year, g(1), g(2)), era))
    for era, base in ERAS:
        year = first(f"{era}\\s*(\\d+)年", lambda g, base=base: (g(1).try_cast("int") + base).cast("string"), era)
        tries.append(first(kanji_day, lambda g, year=year: _iso(year, kanji_number(g(1)), kanji_number(g(2))), era))
    return F.coalesce(*tries, western_date(c))


def month_day_date(label: Column | str, year: Column | str) -> Column:
    """Month and day of a label with a year from elsewhere."""
    c, p = half_width_digits(_col(label)), "(\\d{1,2})月(\\d{1,2})日"
    return F.when(c.rlike(p), _iso(_col(year), F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2)))


def filename_date(c: Column | str) -> Column:
    """R080106… as an ISO date: era letter, two digits each of year, month and day; 00 stands for 01."""
    c = _col(c)
    p = "(?i)^([RHS])(\\d{2})(\\d{2})(\\d{2})"
    fixed = lambda i: F.when(F.regexp_extract(c, p, i) == "00", "01").otherwise(F.regexp_extract(c, p, i))
    out = F.lit(None).cast("int")
    for letter, base in ERA_LETTERS:
        out = F.when(F.upper(F.regexp_extract(c, p, 1)) == letter, F.regexp_extract(c, p, 2).try_cast("int") + base).otherwise(out)
    return F.when(c.rlike(p), _iso(out, fixed(3), fixed(4)))


def estimated_date(c: Column | str) -> Column:
    """A full date, or the first day of a month that stands alone."""
    c = half_width_digits(_col(c))
    tries = [era_date(c)]
    for era, base in ERAS:
        p = f"{era}(\\d+|元)年\\s*(\\d{{1,2}})月"
        tries.append(F.when(c.rlike(p), _iso(era_year(F.lit(era), F.regexp_extract(c, p, 1)), F.regexp_extract(c, p, 2), F.lit("01"))))
    p = "(\\d{4})年\\s*(\\d{1,2})月"
    tries.append(F.when(c.rlike(p), _iso(F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2), F.lit("01"))))
    return F.coalesce(*tries)


def era_labels(year: Column | str) -> Column:
    """How a western year may be written in eras: 2019 lies in two, and its Reiwa year has two spellings; years before are Heisei."""
    y = _col(year)
    label = lambda era, base: F.concat(F.lit(era), (y - base).cast("string"), F.lit("年"))
    return F.when(y > 2019, F.array(label("令和", 2018))).when(y == 2019, F.array(F.lit("令和元年"), label("令和", 2018), label("平成", 1988))).otherwise(F.array(label("平成", 1988)))


def label_year(c: Column | str) -> Column:
    """The year that a list label names, by era or in western digits."""
    c = half_width_digits(_col(c))
    tries = [_found(c, f"{era}\\s*(\\d+|元)\\s*年", 1) for era, _ in ERAS]
    return F.coalesce(*[era_year(F.lit(era), t) for (era, _), t in zip(ERAS, tries, strict=True)], _found(c, "(\\d{4})\\s*年", 1).try_cast("int"))


def within_years(c: Column | str, year: int, slack: int = 1) -> Column:
    """Labels without a year, or with one at most slack from year."""
    y = label_year(c)
    return y.isNull() | (F.abs(y - year) <= slack)


def fiscal_year(date: Column | str) -> Column:
    """The year in which the fiscal year of a date began (April)."""
    return F.year(_col(date)) - F.when(F.month(_col(date)) < 4, 1).otherwise(0)


def valid_date(c: Column | str) -> Column:
    """The date itself, null for months and days that do not exist."""
    return F.try_to_timestamp(_col(c), F.lit("yyyy-MM-dd")).cast("date")


def default_years(this_year: int, n: int = 5) -> list[int]:
    return [this_year - i for i in range(n)]
