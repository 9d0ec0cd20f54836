"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, vertex string, size string"


def alike(bits: int) -> tuple[str, str]:
    """Two words of 2**bits letters, first the other's complement, that sums of powers of any odd base confuse modulo 2**64."""
    first = "".join("ab"[i.bit_count() % 2] for i in range(1 << bits))
    return first, first.translate({97: 98, 98: 97})


def documents(seed: int = 7, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["été", "ñu", "#a", "x|y", "Über", "<b>"]
    passage = " ".join(rng.choice(words) for _ in range(120))
    texts: list = [None, "", " \n\t ", "one two", "one two", "Only A Few Words here"]
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 260)))
        if i % 5 == 0:
            cut = rng.randrange(len(t))
            t = t[:cut] + " " + passage + " " + t[cut:]
        if i % 7 == 0:
            t = t.replace(" ", "\n", 3)
        texts.append(t)
    base = texts[10]
    texts += [base, base, base + " tail", "lead " + texts[12], " ".join(texts[15].split()[:-2]), "ab " * 600, "na " * 500 + passage, "漢字かな" * 300, "y" * 1500, "y" * 900 + "z"]
    w = texts[20].split()
    for k in range(4):  # near copies of each other
        v = list(w)
        v[rng.randrange(len(v))] = f"edit{k}"
        texts.append(" ".join(v))
    lead = texts[20].split()[:17]
    for bits in (10, 11):
        for x in alike(bits):
            texts += [x, "c" * 8 + x, " ".join([*[f"k{bits}x{j}" for j in range(17)], x, *[f"z{bits}x{j}" for j in range(17)]]), " ".join(lead) + "\n" + " ".join({"a": "la", "b": "le"}[c] for c in x)]
    sources = ["s1", "s1", "s1", "b", "a", None, "é", ""]
    rows = [(i, t, "en", sources[i % len(sources)], len(t or ""), i % 3, "v", "s") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def repeated(rows: list[tuple]) -> list[tuple]:
    """Some rows once more, and a row without an id."""
    return [*rows, rows[0], rows[5], rows[5], (None, "no id here at all", "en", None, 3, 0, "", "")]
