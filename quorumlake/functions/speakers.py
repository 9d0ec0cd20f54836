"""Speaker headers of the page families: each function gives a struct of role, name and what else the header holds."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import ROLE_SUFFIXES, role_suffix
from .text import MARKERS, SPACE, _col, trim_all

#: Fixed value: honorifics after names.
HONORIFIC = "(さん|くん|君)$"


def _none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def voice_title(c: Column | str) -> Column:
    """◯role（name） or ◯role."""
    bare = trim_all(F.regexp_replace(_col(c), f"^[{MARKERS}]\\s*", ""))
    p = "^(.+?)（(.+?)）$"
    name = _none_if_empty(trim_all(F.regexp_replace(trim_all(F.regexp_extract(bare, p, 2)), HONORIFIC, "")))
    return F.when(bare.rlike(p), F.struct(trim_all(F.regexp_extract(bare, p, 1)).alias("role"), name.alias("name"))).otherwise(F.struct(_none_if_empty(bare).alias("role"), F.lit(None).cast("string").alias("name")))


def schedule_title(c: Column | str) -> Column:
    """role（name） or （name） alone."""
    bare = trim_all(c)
    both, alone = "^([^（()]+?)（([^）]+?)）$", "^（([^）]+?)）$"
    honest = lambda x: F.regexp_replace(trim_all(x), "(君|議員)$", "")
    none = F.lit(None).cast("string")
    return (
        F.when(bare.rlike(both), F.struct(trim_all(F.regexp_extract(bare, both, 1)).alias("role"), honest(F.regexp_extract(bare, both, 2)).alias("name")))
        .when(bare.rlike(alone), F.struct(none.alias("role"), honest(F.regexp_extract(bare, alone, 1)).alias("name")))
        .otherwise(F.struct(none.alias("role"), none.alias("name")))
    )


def marked_header(c: Column | str) -> Column:
    """Marker, then role（name）, or name and role with a space between, or a role alone."""
    c, marker = _col(c), "^([◎○◯●◆])\\s*"
    a, b, r = f"{marker}(.+?)（(.+?)）$", f"{marker}(.+?){SPACE}+(.+)$", f"{marker}(.+)$"
    person = lambda x: _none_if_empty(F.regexp_replace(F.regexp_replace(trim_all(x), HONORIFIC, ""), f"{SPACE}+", ""))
    none = F.lit(None).cast("string")
    make = lambda role, name, mark: F.struct(role.alias("role"), name.alias("name"), mark.alias("marker"))
    return (
        F.when(c.rlike(a), make(_none_if_empty(trim_all(F.regexp_extract(c, a, 2))), person(F.regexp_extract(c, a, 3)), F.regexp_extract(c, a, 1)))
        .when(c.rlike(b), make(_none_if_empty(trim_all(F.regexp_extract(c, b, 3))), person(F.regexp_extract(c, b, 2)), F.regexp_extract(c, b, 1)))
        .when(c.rlike(r), make(_none_if_empty(trim_all(F.regexp_extract(c, r, 2))), none, F.regexp_extract(c, r, 1)))
        .otherwise(make(none, none, none))
    )


#: Fixed value: a header at the head of a text: marker, role, name in brackets, and a remark such as that someone stepped up.
HEADER = f"^[{MARKERS}][^（\\n]*(?:（[^）]*）)?(?:〔[^〕]*〕)?{SPACE}*"


def without_header(c: Column | str) -> Column:
    """A text without the speaker's header at its head."""
    return trim_all(F.regexp_replace(_col(c), HEADER, ""))


def leading_title(c: Column | str) -> Column:
    """The header at the head of a text, ◯role（name） or ◯role, as voice_title reads it; empty without one."""
    return F.regexp_extract(_col(c), f"^([{MARKERS}][^（\\n]+?(?:（[^）]+?）)?){SPACE}", 1)


def anchored_utterance(c: Column | str) -> Column:
    """role, name, marker and content of a text that begins with ◎role（name）, ◎name role and two spaces, or ◎role; null for other texts and for headers without content."""
    blank, mark = SPACE[1:-1], "[◎○◯●◆]"
    forms = (f"^({mark}[^（\\n]*（[^）]*）){SPACE}*", f"^({mark}[^{blank}]+{SPACE}+[^{blank}]+){SPACE}{{2,}}", f"^({mark}[^{blank}（]+){SPACE}*")

    def parts(x: Column) -> Column:
        found = F.coalesce(*[F.when(x.rlike(p), F.struct(F.regexp_extract(x, p, 0).alias("all"), F.regexp_extract(x, p, 1).alias("head"))) for p in forms])
        return F.struct(found["head"].alias("head"), trim_all(F.substring(x, F.length(found["all"]) + 1, F.length(x))).alias("content"))

    def said(x: Column) -> Column:
        head = marked_header(x["head"])
        return F.when(x["content"] != "", F.struct(head["role"].alias("role"), head["name"].alias("name"), head["marker"].alias("marker"), x["content"].alias("content")))

    # bound step by step, so that what a step reads is computed once
    return F.transform(F.transform(F.array(_col(c)), parts), said)[0]


def utterance(c: Column | str) -> Column:
    """role, name and content of an utterance that begins with its header: role（name君） or namerole, then a space.

    A numbered seat is a member; a role is cut to the suffix that it ends with; after a marker, an unknown header is a name.
    """
    c = _col(c)
    marked = c.rlike(f"^[{MARKERS}]")
    bare = F.regexp_replace(c, f"^[{MARKERS}]\\s*", "")
    head_p, paren_p = "^([^\\s　]{1,50})[\\s　]+", "^(.*?)[（(]([^（）()]*)[君様][）)]$"
    head = F.regexp_extract(bare, head_p, 1)
    body = trim_all(F.regexp_replace(bare, head_p, ""))
    part, name = trim_all(F.regexp_extract(head, paren_p, 1)), _none_if_empty(trim_all(F.regexp_extract(head, paren_p, 2)))
    has_paren, has_head = head.rlike(paren_p), bare.rlike(head_p)
    none = F.lit(None).cast("string")
    make = lambda role, who, content: F.struct(role.alias("role"), who.alias("name"), content.alias("content"))
    tail = role_suffix(head, ROLE_SUFFIXES)
    before = _none_if_empty(F.substring(head, F.lit(1), F.length(head) - F.length(tail)))
    return (
        F.when(has_head & has_paren & part.rlike("^[\\d０-９]+番$"), make(F.lit("議員"), name, body))
        .when(has_head & has_paren & role_suffix(part).isNotNull(), make(role_suffix(part), name, body))
        .when(has_head & has_paren & name.isNotNull() & marked, make(_none_if_empty(trim_all(F.regexp_replace(part, "[（(][^）)]*[）)]", ""))), name, body))
        .when(has_head & tail.isNotNull(), make(tail, before, body))
        .when(has_head & marked, make(none, head, body))
        .otherwise(make(none, none, trim_all(bare)))
    )


def seat_header(c: Column | str) -> Column:
    """n．role（name君）."""
    p = "^\\s*([0-9０-９]+)[．.]\\s*(.+?)[（(](.+?)君?[）)]"
    c = _col(c)
    return F.when(c.rlike(p), F.struct(F.translate(F.regexp_extract(c, p, 1), "０１２３４５６７８９", "0123456789").cast("int").alias("seat"), trim_all(F.regexp_extract(c, p, 2)).alias("role"), trim_all(_part(c, p, 3)).alias("name")))
