"""Operators 11 to 13 against plain Python, and against their SQL on tables with the hard cases."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from quorumlake.llm import divergence, personal, vector_codes
from quorumlake.llm.queries import ORACLE_SQL

from .data import SCHEMA, documents, repeated


def text_key(row):
    return tuple(map(str, row))


def against_sql(name, df, table, rows, columns):
    """The operator's rows against its query's SQL over the same rows."""
    import pandas as pd  # noqa: F401

    c = duckdb.connect()
    c.execute(f"CREATE TABLE {table} ({columns})")
    c.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", [list(r) for r in rows])
    r = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(x) for x in df.select(*names).collect()), key=text_key) == sorted(r.fetchall(), key=text_key)


# divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows, least, most):
    df, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        text, lang, source = r[1] or "", r[2] or "", r[3] or ""
        groups.add((lang, source))
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text)]
        df[lang].update(set(words))
        count[lang, source].update(words)
        count[lang, None].update(words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((w for w, n in df[lang].items() if n >= least), key=str.encode)
        share = {}
        for g in [*(s for x, s in groups if x == lang), None]:
            n = sum(count[lang, g][w] for w in kept)
            share[g] = {w: 1 + math.floor(Fraction(10**9 * (count[lang, g][w] + 5), n + 5 * len(kept))) for w in kept}
        mine = [s for x, s in groups if x == lang]
        for s in mine:
            pairs = [(-sum(abs(share[s][w] - share[o][w]) for w in kept), o.encode()) for o in mine if o != s]
            terms = [(share[None][w] - share[s][w], w.encode()) for w in kept if count[lang, s][w] and share[s][w] > share[None][w]]
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", w.decode(), -v, i + 1) for i, (v, w) in enumerate(sorted(terms)[:most])]
    return out


def divergence_rows(seed=5):
    rng = random.Random(seed)
    words = [*[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)], "été", "ÉTÉ", "漢字", "Über", "über", "Z", "z", "😀", "a1b", "x_y"]
    rows = []
    for i in range(150):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot", "hot", "b", "é", None, "", "Z"])
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))), lang, source, 0, i, "v", "s"))
    rows += [(None, None, "fr", "alone", None, 0, "", ""), (900, "seldom words", "fr", "two", 0, 0, "", ""), (901, "1234 !!", "xx", None, 0, 0, "", ""), (902, "A" * 300_000 + " wab", "en", "hot", 0, 0, "", "")]
    return [*rows, rows[0], rows[1], rows[1]]


@pytest.mark.parametrize(("width", "tile", "chunk_rows"), [(4096, 256, 200_000), (7, 2, 40)])
def test_divergence(spark, width, tile, chunk_rows):
    """Many small chunks, parts and tiles give what one of each does."""
    rows = divergence_rows()
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA), 6, 9, width, tile, chunk_rows)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    want = plain_divergence(rows, 6, 9)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "fr" for r in want)
    assert sorted((tuple(r) for r in got.collect()), key=text_key) == sorted(want, key=text_key)


def test_divergence_sql_and_empty_table(spark):
    rows = [(r[0], r[1], r[2], r[3], 0, 0, "", "") for r in divergence_rows() * 3]
    table = "doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint, block bigint, vertex varchar, size varchar"
    against_sql("op11_divergence", divergence.divergence(spark.createDataFrame(rows, SCHEMA)), "documents", rows, table)
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    hard = repeated(documents(n=20))
    assert divergence.divergence(spark.createDataFrame(hard, SCHEMA), 3).count() == len(plain_divergence(hard, 3, 50))


def test_shares_are_exact():
    """Also where the unit times a count is beyond 64 bits."""
    rng = random.Random(1)
    for _ in range(200):
        total, terms = rng.randrange(10 ** rng.randrange(1, 16)), rng.randrange(1, 10**6)
        count = rng.randrange(total + 1)
        assert divergence.shares(np.array([count]), np.array([total]), terms)[0] == 1 + 10**9 * (count + 5) // (total + 5 * terms)


# vector codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, salt int"


def plain_codes(rows, entries=64, rounds=2):
    fine = [r for r in rows if r[1] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) == len(rows[0][1])]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, [float(np.float32(x)) for x in r[1]]))
    v = np.array([[math.floor(256 * float(np.float32(x))) for x in r[1]] for r in fine]).reshape(len(fine), 16, -1)
    books = v[:entries].transpose(1, 0, 2).copy()

    def nearest(p):
        d = ((v[:, p, None, :] - books[p][None]) ** 2).sum(-1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p in range(16):
            at, _ = nearest(p)
            for e in range(len(books[p])):
                if (at == e).any():
                    books[p, e] = [math.floor(Fraction(int(s), int((at == e).sum()))) for s in v[at == e, p].sum(0)]
    at, d = zip(*(nearest(p) for p in range(16)), strict=True)
    error = np.sum(d, 0)
    by = Counter()
    for r, e in zip(fine, error.tolist(), strict=True):
        by[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for p in range(16) for e in range(len(books[p])) for x in books[p, e]).encode()).hexdigest()
    return [(r[0], "".join(f"{at[p][i]:02x}" for p in range(16)), int(error[i]), by[r[2]], sha) for i, r in enumerate(fine)]


def vector_rows(n, seed=3, dim=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    rows = [(i, (centres[i % 9] * 0.4 + rng.normal(size=dim) * 0.2).astype(np.float32).tolist(), [None, 1, 2, 1, 1][i % 5], "x", i) for i in range(n)]
    return rows


@pytest.mark.parametrize("n", [3, 63, 500])
def test_codes(spark, n):
    rows = vector_rows(n)
    if n > 100:
        rows += [(1000 + i, rows[7][1], 2, "", 0) for i in range(40)] + [rows[3], (None, rows[5][1], None, "", 0), (None, rows[6][1], 9, "", 0)]
        rows += [(2000, None, 1, "", 0), (2001, [1.0, None, *[0.0] * 30], 1, "", 0), (2002, [float("nan")] * 32, 1, "", 0), (2003, [float("inf")] * 32, 1, "", 0), (2004, [0.0] * 32, 1, "", 0), (2005, [], 1, "", 0), (-5, [], 1, "", 0), (2006, [1.0] * 31, 1, "", 0), (2007, [1.0] * 48, 1, "", 0), (2008, [3e20] * 32, 1, "", 0)]
    want = plain_codes([r for r in rows if r[0] != 2008])
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3), block_values=2048)
    assert sorted((tuple(r) for r in got.collect()), key=text_key) == sorted(want, key=text_key)


def test_more_rounds_and_far_components(spark):
    """Heaps carried over several rounds; integers that need 32 bits."""
    rows = [(i, [x * (900.0 if i % 50 == 0 else 1.0) for x in v], *rest) for i, v, *rest in vector_rows(400)]
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS), rounds=5, entries=20, block_values=1 << 14)
    assert sorted((tuple(r) for r in got.collect()), key=text_key) == sorted(plain_codes(rows, 20, 5), key=text_key)


def test_heaps_leave_parts_alone():
    """Rounds pop fewer and fewer parts, and end where comparing all parts in every round does."""
    rng = np.random.default_rng(4)
    data = np.floor(rng.normal(size=(16, 3000, 4)) * 100).astype(np.int64)
    books = data[:, :64].copy()
    block = vector_codes.Block(data, 64)
    block.fill(books)
    drift, popped = np.zeros((16, 64)), []
    for _ in range(20):
        sums = block.sums()
        new = np.where(sums[:, :, :1] > 0, sums[:, :, 1:] // np.maximum(sums[:, :, :1], 1), books)
        drift, books = drift + vector_codes.drifts(books, new), new
        row = {"ids": range(3000)} | block.row()
        block = vector_codes.Block.read(row, 4)
        popped.append(block.settle(books, drift))
        for p in range(16):
            assert (block.assigned[p] == vector_codes.nearest_two(data[p], books[p])[0]).all()
    assert popped[-1] < popped[0] < data.shape[0] * data.shape[1] and popped[-1] < 0.5 * 16 * 3000


def test_codes_sql_and_empty_table(spark):
    rows = [(r[0], r[1], r[2], "x", 0) for r in vector_rows(300)]
    rows += [(400, None, 1, "", 0), (401, [None, *rows[0][1][1:]], 1, "", 0), (402, [float("nan"), *rows[0][1][1:]], 1, "", 0)]
    against_sql("op12_codes", vector_codes.compress(spark.createDataFrame(rows, VECTORS)), "embeddings", rows, "vec_id bigint, embedding float[], label int, code varchar, salt int")
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.compress(spark.createDataFrame(rows[-3:], VECTORS)).count() == 0


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_base(text):
    out = []
    for k, kind in enumerate(BASE):
        for m in re.finditer(BASE[kind], text):
            d = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": all(int(x[-5:]) <= 255 and not x[:-5].strip("0") for x in m.group().split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and plain_luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]
            if fine:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def card(prefix, n, rng):
    s = prefix + "".join(rng.choice("0123456789") for _ in range(n - len(prefix) - 1))
    return next(s + c for c in "0123456789" if plain_luhn(s + c))


def iban(country, rest):
    return next(f"{country}{k:02d}{rest}" for k in range(98) if int("".join(str(int(x, 36)) for x in f"{rest}{country}{k:02d}")) % 97 == 1)


def personal_rows():
    rng = random.Random(2)
    good, de = card("4", 16, rng), iban("DE", "370400440532013000")
    spaced = " ".join(de[i : i + 4] for i in range(0, 22, 4))
    texts = [
        None, "", "a@b.c_d@e.f a@b a@@b.cc x@y.z. é.t@m.fr ü@x.yz @a.bc", "1.2.3.4.5 256.1.1.1 001.02.003.255 1.2.3 9.9.9.9999999 version 1.2.3.4 host 10.0.0.1",
        f"card {good} and {good[:4]} {good[4:8]}-{good[8:]} but {good[:-1]}{(int(good[-1]) + 1) % 10}, 1 2", f"😀 {good}5 {good}", "+1 (017) 555-7713, +1((((, +49.30-12 , +123456789012345678 tel +1 017 5557713)",
        f"iban {de}. {spaced}, {de[:-1]}{(int(de[-1]) + 1) % 10} X{de} {de}9 {de.lower()}", f"{iban('GB', 'WEST12345698765432')} {iban('NO', '93011117947'[:11])} AND MORE",
        f"visa {good[:4]}.{good[4:8]}.{good[8:12]}.{good[12:]} far", f"{good[:4]}.{good[4:8]}.{good[8:12]}.{good[12:]}", "ssn 123-45-6789, SSN: 000-12-3456", "123-45-6789", "call (030) 1234-567 or 555.123.4567", "sum 555 123 4567",
        "telephone 555-123-4567" + " x" * 40 + " 555-123-4567", f"é{good}", "9" * 3_000, "a" * 3_000 + "@" + "b" * 3_000, ("1." * 2_000), "+" + "1(" * 3_000, "x" * 30_000 + " mail me@it.org " + "y " * 30_000,
        "00000000000000000000000001.1.1.1 " + "1" * 30 + ".1.1.1", f"tel {good} Konto {de} card {good}",
    ]
    pieces = ["a@b.c", "1.2.3.4", good, de, "+1 555 123-4567", "é", "😀", " ", ".", "-", "+", "(", "call ", "IBAN ", "ssn ", "123-45-6789", "12", "_", "@", "visa ", "\n"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(150)]
    return [(i if i % 9 else None, x, "en", "s", 0, 0, "", "") for i, x in enumerate(texts)]


def test_personal(spark):
    rows = personal_rows() + repeated(documents(n=20))
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in personal.digest(personal.find_personal(spark.createDataFrame(rows, SCHEMA))).collect())
    want = Counter()
    for r in rows:
        base = plain_base(r[1] or "")
        n = Counter(x.split(":")[0] for x in base)
        want[r[0], n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(base).encode()).hexdigest()] += 1
    assert got == want


def test_personal_sql(spark):
    """The checks, words and overlaps of added spans too."""
    rows = personal_rows()
    table = "doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint, block bigint, vertex varchar, size varchar"
    against_sql("op13_personal", personal.digest(personal.find_personal(spark.createDataFrame(rows, SCHEMA))), "documents", rows, table)


def test_personal_scores_and_redaction(spark):
    de = iban("DE", "370400440532013000")
    rows = [(1, f"Konto {de} oder tel 030 1234-567, 4 5", "de", "s", 0, 3, "v", "z"), (2, "version 1.2.3.4", "en", "s", 0, 3, "v", "z"), (3, None, None, None, None, None, None, None), (4, "nothing 12 34", "", "", 0, 0, "", "")]
    got = {r.doc_id: r for r in personal.find_personal(spark.createDataFrame(rows, SCHEMA), extra=["block", "size"]).collect()}
    assert got[1].redacted == "Konto [iban] oder tel [phone], 4 5" and [s.score for s in got[1].spans] == [100, 70] and (got[1].block, got[1].size) == (3, "z")
    assert [(s.kind, s.score, s.base) for s in got[2].spans] == [("ip", 30, True)]
    assert got[3].redacted == "" and got[3].spans == [] and got[4].redacted == "nothing 12 34"
    assert personal.find_personal(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text", ["9" * 10**6, "a" * 10**6 + "@" + "b" * 10**6, "1." * 10**6, "+" + "1(" * 10**6, "+" * 10**6, "1 " * 10**6 + "@", "a@" * 10**6, "a.b-" * 10**6 + "@c"])
def test_long_runs_take_time_in_proportion(text):
    began = time.perf_counter()
    personal.personal_spans(text)
    assert time.perf_counter() - began < 30


def test_checks():
    assert personal.luhn("4539578763621486") and not personal.luhn("4539578763621487")
    assert personal.mod_97("GB82 WEST 1234 5698 7654 32") and not personal.mod_97("GB83WEST12345698765432")
    assert personal.redacted("abcdef", [("x", 1, 3, 0, True), ("y", 2, 4, 0, True), ("z", 4, 5, 0, True)]) == "a[x][z]f"
