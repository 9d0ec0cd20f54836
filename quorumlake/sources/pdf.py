"""Text of PDF files: what their pages show, decoded by the fonts' own tables, in the order of the file or as it lies on the page.

A helper of tasks for `pages.file_text` and `pages.texts_side_by_side`. Files that are encrypted, or that hold pictures of
text alone, give an empty text, so that another strategy may follow.
"""

import re
import zlib
from functools import lru_cache

_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[+-]?[0-9]*\.?[0-9]+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
#: Predefined encodings of Japanese fonts.
ENCODINGS = {b"UniJIS-UTF16-H": "utf-16-be", b"UniJIS-UTF16-V": "utf-16-be", b"UniJIS-UCS2-H": "utf-16-be", b"90ms-RKSJ-H": "cp932", b"90ms-RKSJ-V": "cp932", b"EUC-H": "euc_jp"}


def _stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return b""
    return zlib.decompressobj().decompress(m[1]) if b"FlateDecode" in body[: m.start()] else m[1]


def _objects(raw: bytes) -> dict[int, bytes]:
    """Number and body of each object, those packed into object streams included; of several with a number the last holds."""
    out = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", raw, re.S)}
    for body in [b for b in out.values() if b"/ObjStm" in b]:
        data, first = _stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
        head = [int(x) for x in data[:first].split()]
        ends = [*head[3::2], len(data) - first]
        for number, start, end in zip(head[::2], head[1::2], ends, strict=True):
            out.setdefault(number, data[first + start : first + end])
    return out


def _references(body: bytes, name: bytes) -> list[int]:
    """Numbers of the objects that an entry refers to, one or an array of them."""
    m = re.search(rb"/" + name + rb"\s*(?:\[([^\]]*)\]|(\d+\s+\d+\s+R))", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1] or m[2] or b"")] if m else []


def _dictionary(objects: dict[int, bytes], body: bytes, name: bytes) -> bytes:
    """The text of an entry that is a dictionary, in place or in an object of its own."""
    found = _references(body, name)
    if found:
        return objects.get(found[0], b"")
    m = re.search(rb"/" + name + rb"\s*<<", body)
    if not m:
        return b""
    depth, at = 1, m.end()
    while depth and (n := re.compile(rb"<<|>>").search(body, at)):
        depth, at = depth + (1 if n[0] == b"<<" else -1), n.end()
    return body[m.end() : at]


@lru_cache(64)
def _code_map(cmap: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code, and the text of each code, of a ToUnicode table."""
    said = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode()).decode("utf-16-be", "replace")
    space = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {int(a, 16): said(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, to, each in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            low, high = int(a, 16), min(int(b, 16), int(a, 16) + 0xFFFF)
            if to:
                base = said(to)
                out |= {i: base[:-1] + chr(ord(base[-1]) + i - low) for i in range(low, high + 1)}
            else:
                out |= {low + i: said(x) for i, x in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", each))}
    return (len(space[1]) // 2 if space else 1), out


def _decoder(objects: dict[int, bytes], font: bytes):
    table = _references(font, b"ToUnicode")
    if table and table[0] in objects:
        width, codes = _code_map(_stream(objects[table[0]]))
        return lambda s: "".join(codes.get(int.from_bytes(s[i : i + width], "big"), "") for i in range(0, len(s), width))
    named = re.search(rb"/Encoding\s*/([\w-]+)", font)
    return lambda s: s.decode(ENCODINGS.get(named[1] if named else b"", "cp1252"), "replace")


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1]).decode()
        return bytes.fromhex(digits + "0" * (len(digits) % 2))
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _PLAIN.get(m[1], m[1]), token[1:-1])


def _pieces(content: bytes, fonts: dict[bytes, object]) -> list[tuple[float, float, str]]:
    """(x, y, text) of the strings that a page shows, in the order of its content; places are those of the line's start."""
    out, stack, decode = [], [], lambda s: s.decode("cp1252", "replace")
    x = y = leading = 0.0
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[]/" or re.fullmatch(rb"[+-]?[0-9]*\.?[0-9]+", t):
            stack.append(t)
            continue
        numbers = [float(v) for v in stack if v[:1] not in b"(<[]/"]
        if t == b"Tf":
            decode = fonts.get(next((v[1:] for v in stack if v[:1] == b"/"), b""), decode)
        elif t == b"BT":
            x = y = 0.0
        elif t == b"Tm" and len(numbers) >= 6:
            x, y = numbers[-2:]
        elif t in (b"Td", b"TD") and len(numbers) >= 2:
            x, y = x + numbers[-2], y + numbers[-1]
            leading = -numbers[-1] if t == b"TD" else leading
        elif t == b"TL" and numbers:
            leading = numbers[-1]
        elif t in (b"T*", b"'", b'"'):
            y -= leading
        if t in (b"Tj", b"TJ", b"'", b'"'):
            said = "".join(decode(_string(v)) for v in stack if v[:1] in b"(<")
            if said:
                out.append((x, y, said))
        stack = []
    return out


@lru_cache(1)  # several strategies look at one file in turn
def _page_pieces(raw: bytes) -> list[list[tuple[float, float, str]]]:
    objects = _objects(raw)
    order: list[int] = []

    def walk(number: int, seen: frozenset) -> None:
        body = objects.get(number, b"")
        if number in seen:
            return
        kids = _references(body, b"Kids")
        for kid in kids:
            walk(kid, seen | {number})
        if not kids and re.search(rb"/Type\s*/Page\b", body):
            order.append(number)

    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Catalog\b", b)]
    for root in roots[-1:]:
        for top in _references(objects[root], b"Pages"):
            walk(top, frozenset())
    order = order or sorted(n for n, b in objects.items() if re.search(rb"/Type\s*/Page\b", b))
    out = []
    for number in order:
        body = held = objects[number]
        while b"/Resources" not in held and (up := _references(held, b"Parent")):  # inherited from the tree
            held = objects.get(up[0], b"")
        named = _dictionary(objects, _dictionary(objects, held, b"Resources"), b"Font")
        fonts = {n: _decoder(objects, objects.get(int(at), b"")) for n, at in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", named)}
        content = b"\n".join(_stream(objects.get(n, b"")) for n in _references(body, b"Contents"))
        out.append(_pieces(content, fonts))
    return out


def text_in_order(raw: bytes) -> str:
    """Strings in the order of the file, a line for each height at which text stands."""
    lines: list[str] = []
    for pieces in _page_pieces(raw):
        last = None
        for _, y, said in pieces:
            if last is not None and abs(y - last) < 1:
                lines[-1] += said
            else:
                lines.append(said)
            last = y
    return "\n".join(lines)


def text_in_layout(raw: bytes) -> str:
    """Lines from the top of each page, columns from left to right with two blanks between them."""
    lines: list[str] = []
    for pieces in _page_pieces(raw):
        rows: dict[int, list[tuple[float, int, str]]] = {}
        for place, (x, y, said) in enumerate(pieces):
            rows.setdefault(round(y), []).append((x, place, said))
        for y in sorted(rows, reverse=True):
            columns: dict[float, str] = {}
            for x, _, said in sorted(rows[y]):
                columns[x] = columns.get(x, "") + said  # pieces from one start run on
            lines.append("  ".join(columns.values()))
    return "\n".join(lines)
