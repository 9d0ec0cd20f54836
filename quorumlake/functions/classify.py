"""Classification of meetings, speakers and utterances by rule tables."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, _col, trim_all

#: Meeting types by words in a title, in the order in which each source tries them; else plenary.
MEETING_TYPE_RULES = {
    "committee_first": (("委員会", "committee"), ("臨時", "extraordinary")),
    "committee_first_strict": (("委員会", "committee"), ("臨時会", "extraordinary")),
    "extraordinary_first": (("臨時会", "extraordinary"), ("委員会", "committee")),
    "no_committee": (("臨時会", "extraordinary"),),
}
#: Roles of those who answer for the administration.
ANSWER_ROLES = (
    "市長", "町長", "村長", "副市長", "副町長", "副村長", "副知事", "知事", "部長", "課長", "室長", "局長", "係長", "主任", "補佐",
    "主査", "事務局長", "議会事務局長", "書記", "参事", "次長", "理事", "総務部長", "財政部長",
)
#: The same in the tree-navigated page family.
TREE_ANSWER_ROLES = (
    "市長", "町長", "村長", "副市長", "副町長", "副村長", "市長室長", "支所長", "センター長", "部長", "課長", "室長", "局長", "係長",
    "主任", "補佐", "主査",
)
#: Role suffixes, the one that comes first wins.
ROLE_SUFFIXES = (
    "委員長", "副委員長", "副議長", "副市長", "副町長", "副村長", "副部長", "副課長", "市長室長", "支所長", "センター長", "議長",
    "市長", "町長", "村長", "委員", "議員", "部長", "課長", "室長", "局長", "係長", "主任", "補佐", "主査",
)
SEAT_NUMBER = "^[0-9０-９]+番$"


def meeting_type(title: Column | str, rules: str = "committee_first") -> Column:
    out = F.lit("plenary")
    for word, kind in reversed(MEETING_TYPE_RULES[rules]):
        out = F.when(_col(title).contains(word), kind).otherwise(out)
    return out


def _ends_with_any(c: Column, words: tuple) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.endswith(c, w))


def utterance_kind(role: Column | str, default: str = "remark") -> Column:
    """question for members, remark for chairs, answer for the administration, else the default; a missing role is a remark."""
    r = _col(role)
    return (
        F.when(r.isNull() | (r == ""), "remark")
        .when(r.endswith("議員") | r.endswith("委員") | r.rlike(SEAT_NUMBER), "question")
        .when((r == "議長") | r.endswith("委員長"), "remark")
        .when(_ends_with_any(r, ANSWER_ROLES), "answer")
        .otherwise(default)
    )


def utterance_kind_marked(role: Column | str, marker: Column | str) -> Column:
    """The same where a marker tells the administration (◎) and committee members (◆)."""
    r, m = _col(role), _col(marker)
    return F.when(r.isNull() | (r == ""), "remark").when(m == "◎", "answer").when(m == "◆", "question").when(r.endswith("議長") & ~r.rlike(SEAT_NUMBER), "remark").otherwise(utterance_kind(r))


def utterance_kind_tree(role: Column | str) -> Column:
    """The tree-navigated family: whoever does not answer or preside asks."""
    r = _col(role)
    return F.when(r.isNull() | (r == ""), "remark").when(r.isin(*TREE_ANSWER_ROLES), "answer").when(r.isin("議長", "委員長"), "remark").when(_ends_with_any(r, TREE_ANSWER_ROLES), "answer").otherwise("question")


def kind_by_code(code: Column | str) -> Column:
    """Codes of the JSON family; null for rows that are no utterances."""
    c = _col(code)
    return F.when(c == 4, "remark").when(c == 5, "question").when(c == 6, "answer")


def role_suffix(c: Column | str, suffixes: tuple = ROLE_SUFFIXES) -> Column:
    """The first suffix in the list that a text ends with; null without."""
    return F.try_element_at(F.filter(F.array(*[F.lit(s) for s in suffixes]), lambda s: F.endswith(_col(c), s)), F.lit(1))


def normal_role(c: Column | str) -> Column:
    """Seat numbers as members, other roles by their suffix."""
    return F.when(_col(c).rlike(SEAT_NUMBER), "議員").otherwise(role_suffix(c))


#: Marks of the chair and of the agenda, marks that stand before short answers too, their lengths, and how an action is recorded.
CHAIR_MARKS, ANSWER_MARKS, SHORT_ANSWER, SHORT_ACTION, RECORDED_ACTION = ("○", "△"), ("◆", "◎"), 20, 50, "～[^～]{1,30}～"


def is_procedural(c: Column | str, length: Column | None = None) -> Column:
    """Chair's and agenda marks always; short answers and recorded actions under the marks ◆ and ◎."""
    c = _col(c)
    n = F.length(c) if length is None else length
    starts = lambda marks: reduce(lambda a, b: a | b, [c.startswith(m) for m in marks])
    return starts(CHAIR_MARKS) | (starts(ANSWER_MARKS) & ((n < SHORT_ANSWER) | ((n < SHORT_ACTION) & c.rlike(RECORDED_ACTION))))


def is_too_short(c: Column | str, least: int = 5) -> Column:
    return F.length(trim_all(c)) < least


def is_speaker_label(c: Column | str) -> Column:
    """Three tokens or more, each a single CJK character: a name written with spaces."""
    parts = F.split(trim_all(c), f"{SPACE}+")
    return (F.size(parts) >= 3) & F.forall(parts, lambda x: x.rlike("^[\\u3040-\\u9FFF]$"))


def is_noise(c: Column | str, least: int = 5) -> Column:
    return is_procedural(c) | is_too_short(c, least) | is_speaker_label(c)


#: Parts of user agents that are turned away, in any case.
BLOCKED_AGENTS = (
    "python-requests", "scrapy", "wget", "httpx", "aiohttp", "node-fetch", "go-http-client", "java/", "libwww-perl", "apify",
    "postmanruntime", "insomnia", "curl", "okhttp", "axios", "guzzlehttp", "powershell", "httpclient", "gptbot", "ccbot",
    "google-extended", "anthropic-ai", "claudebot", "bytespider", "amazonbot", "cohere-ai",
)


def is_blocked_agent(c: Column | str) -> Column:
    """A missing or empty user agent is blocked too."""
    agent = F.lower(_col(c))
    return F.coalesce((agent == "") | F.exists(F.array(*[F.lit(b) for b in BLOCKED_AGENTS]), lambda b: F.contains(agent, b)), F.lit(True))


def is_allowed_domain(email: Column | str, domains: list[str]) -> Column:
    """Exact domains, and *.domain for any subdomain."""
    at = F.lower(F.substring_index(_col(email), "@", -1))
    exact = [d.lower() for d in domains if not d.startswith("*.")]
    suffixes = [d[1:].lower() for d in domains if d.startswith("*.")]
    out = at.isin(*exact) if exact else F.lit(False)
    for s in suffixes:
        out = out | at.endswith(s)
    return _col(email).contains("@") & out
