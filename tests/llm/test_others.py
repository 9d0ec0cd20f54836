import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import chat, mixing, neighbours, pipeline, quality, sharding
from quorumlake.llm.packing import binary_lengths

from .data import SCHEMA, documents, repeated

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


# quality

def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    in_window = [any(count[tuple(w[j : j + 3])] > 1 for j in range(max(0, i - 2), min(i, len(w) - 3) + 1)) for i in range(len(w))]
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, sum(in_window)


def test_quality_counts(spark):
    rows = repeated(documents())
    rows += [(900, "a\nb\na\n\n a\na", "en", "s", 0, 0, "", ""), (901, "x y z " * 40, "en", "s", 0, 0, "", ""), (902, "#<b>|$ é\n#<b>|$ é", "en", None, 0, 0, "", "")]
    got = quality.quality_rules(frame(spark, rows)).collect()
    want = []
    for r in rows:
        n, chars, symbols, again, repeats = base_counts(r[1])
        want.append((r[0], n, chars, symbols, again, repeats, n < 50 or 100 * repeats > 50 * n))
    key = lambda x: tuple(map(str, x))
    assert sorted(((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got), key=key) == sorted(want, key=key)
    assert all(not x.kept for x in got if x.base_failed)
    assert quality.quality_rules(frame(spark, [])).count() == 0


def test_boilerplate_lines(spark):
    """A line of most documents of a host goes; who is little else is depleted; copies of one text count once."""
    own = lambda i, n: " ".join(f"w{i}_{k}" for k in range(n))
    rows = [(i, f"Menu  HOME {i % 10}\n{own(i, 80)}", "en", "h", 0, 0, "", "") for i in range(30)]
    bar = "MENU home 7 " + " ".join(f"m{k}" for k in range(60))
    rows += [(100 + i, f"{bar}\n{own(i, 5 + i)}", "en", "h", 0, 0, "", "") for i in range(30)]
    rows += [(200 + i, own("same", 90), "en", "h", 0, 0, "", "") for i in range(40)]
    rows += [(300 + i, f"{bar}\n{own(i, 9)}", "en", "other", 0, 0, "", "") for i in range(5)]
    got = {x.doc_id: x for x in quality.quality_rules(frame(spark, rows)).collect()}
    assert all(got[i].kept and got[i].n_boilerplate_words == 3 for i in range(30))
    for i in range(30):
        assert got[100 + i].n_boilerplate_words == 63
        assert got[100 + i].kept == (5 + i >= 0.3 * (68 + i))
    assert all(got[200 + i].kept and got[200 + i].n_boilerplate_words == 0 for i in range(40))
    assert all(got[300 + i].kept for i in range(5))


def letters(n: int) -> str:
    """A word for a number, without digits, which lines take as one class."""
    return "".join(chr(97 + int(c)) for c in str(n))


def test_boilerplate_limit_is_a_number_of_documents(spark, tmp_path):
    """A line of 21 of a host's 200 distinct texts is boilerplate, also in the pipeline's stage, one of 20 is not; both have one law."""
    own = lambda i, n: " ".join(letters(1000 * i + k) for k in range(n))
    often, seldom = " ".join("m" + letters(k) for k in range(50)), " ".join("s" + letters(k) for k in range(50))
    rows = [(i, f"{often}\n{own(i, 10)}", "en", None, 0, 0, "", "") for i in range(21)]
    rows += [(100 + i, f"{seldom}\n{own(100 + i, 10)}", "en", None, 0, 0, "", "") for i in range(20)]
    rows += [(200 + i, own(200 + i, 60), "en", None, 0, 0, "", "") for i in range(159)]
    got = {x.doc_id: x.n_boilerplate_words for x in quality.quality_rules(frame(spark, rows)).collect()}
    assert got == {r[0]: 50 if r[0] < 100 else 0 for r in rows}
    assert {r.doc_id for r in pipeline.quality(spark, frame(spark, rows), str(tmp_path)).collect()} == {r[0] for r in rows if r[0] >= 100}


def test_pipeline_quality_removes_boilerplate_lines(spark, tmp_path):
    """A host's frequent lines go from first, middle and last place; all other bytes stay, n_chars follows."""
    own = lambda i, n: " ".join(letters(1000 * i + k) for k in range(n))
    rows = []
    for i in range(25):
        lines = [f"Menu  HOME {i % 10}", own(i, 60), "", "é " + own(100 + i, 5), " menu home 7"]
        if i == 0:
            lines = ["x", "MENU home 1", own(0, 55), "menu HOME 2", "menu home 3\r"]
        rows.append((i if i % 6 else None, "\n".join(lines), "en", "h", 0))
    rows += [(50, "menu home 1\n" + own(900, 60), "en", "other", 0), (51, "menu home", "en", "h", 0)]
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    gone = re.compile(r"\s*menu\s+home \d+\s*", re.IGNORECASE)
    plain = lambda r: r[1] if r[3] == "other" else "\n".join(x for x in r[1].split("\n") if not gone.fullmatch(x))
    got = pipeline.quality(spark, docs, str(tmp_path)).collect()
    want = [(r[0], plain(r)) for r in rows if r[0] != 51]
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(want, key=key)
    assert all(r.n_chars == len(r.text) for r in got) and any(len(a[1]) < len(b[1]) for a, b in zip(want, rows, strict=False))


# sharding

def test_shards(spark):
    rows = repeated(documents())
    got = sharding.shard_by_bytes(frame(spark, rows), 8).collect()
    size = lambda t: len((t or "").encode()) + 1
    key = lambda x: tuple(map(str, x))
    assert sorted(((x.doc_id, x.size, x.text_crc32) for x in got), key=key) == sorted(((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows), key=key)
    by = defaultdict(list)
    for x in got:
        by[x.shard].append(x)
    total, most = sum(size(r[1]) for r in rows), max(size(r[1]) for r in rows)
    assert set(by) <= set(range(8))
    for s in by.values():
        assert sorted(x.slot for x in s) == list(range(len(s)))
        assert abs(sum(x.size for x in s) - total / 8) <= most
    order = sorted(got, key=lambda x: x.start)
    assert [x.shard for x in order] == sorted(x.shard for x in got)
    ids = [-1 if x.doc_id is None else x.doc_id for x in order]
    assert ids == sorted(ids)
    assert sharding.shard_by_bytes(frame(spark, []), 8).count() == 0
    assert {x.shard for x in sharding.shard_by_bytes(frame(spark, [(1, None, "", "", 0, 0, "", "")]), 8).collect()} <= set(range(8))


def test_written_shards(spark, tmp_path):
    rows = [r for r in documents() if r[0] is not None]
    sharding.write_shards(frame(spark, rows), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


# mixing

def targets_of(sizes: dict, weights, cap):
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        share = {s: left * w[s] / sum(w[x] for x in order if x not in full) for s in order if s not in full}
        over = {s for s, t in share.items() if t > cap * sizes[s]}
        if not over:
            return share | {s: float(cap * sizes[s]) for s in full}
        full |= over


@pytest.mark.parametrize("seed", [2, 4])
def test_mixing(spark, seed):
    """Sizes, targets and taken words against plain Python; a source ends within half of the smallest document that could still move."""
    rng = np.random.default_rng(seed)
    names = ["a", "B", "é", "zz", None, "", "0", "k1", "k2"][: 3 + 2 * (seed - 1)]
    rows = []
    for i in range(600):
        s = names[0] if rng.random() < 0.4 else names[rng.integers(len(names))]
        n = int(rng.pareto(1.5) * 20) if rng.random() > 0.05 else 0
        rows.append((i, None if n == 0 and i % 2 else " ".join(["w"] * n), "en", s, 0, 0, "", ""))
    rows += [rows[3], rows[3]]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    if seed == 2:
        again = mixing.mix_sources(frame(spark, rows[::-1])).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
        parts = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = mixing.mix_sources(frame(spark, rows).repartition(5)).collect()
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert sorted(map(str, got)) == sorted(map(str, again))
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    assert Counter((x.doc_id, x.size) for x in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    want = targets_of(dict(sizes), mixing.WEIGHTS, mixing.CAP)
    by = defaultdict(list)
    for x in got:
        assert x.source_size == sizes[x.source] and math.isclose(x.target, want[x.source], rel_tol=1e-9, abs_tol=1e-6)
        assert x.taken == x.copies * x.size <= 3 * x.size
        taken[x.source] += x.taken
        by[x.source].append(x)
    for s, target in want.items():
        rest = target - taken[s]
        could = [x.size for x in by[s] if x.size and (x.copies < 3 if rest > 0 else x.copies > 0)]
        assert abs(rest) <= min(could, default=0) / 2 + 1e-6
        assert abs(rest) <= max(0.01 * target, min((x.size for x in by[s] if x.size), default=0)) + 1e-6
        # rates are tilted by size: min(3, exp(tilt * size)) with one tilt for the source, and meet the target
        tilts = [math.log(x.rate) / x.size for x in by[s] if x.size and 0 < x.rate < 3 - 1e-9]
        assert not tilts or max(tilts) - min(tilts) <= 1e-6 * max(map(abs, tilts))
        assert math.isclose(sum(x.rate * x.size for x in by[s]), target, rel_tol=1e-8, abs_tol=1e-6)
    assert mixing.mix_sources(frame(spark, [])).count() == 0


def test_rates_solve_the_dual(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("a", 30, 2), ("b", 1, 100), (None, 7, 1), ("z", 0, 4), ("y", 5, 3), ("y", 5000, 2)], "source string, size long, n long")
    targets = spark.createDataFrame([("a", 70, 120.0), ("b", 100, 1.0), (None, 7, 21.0), ("z", 0, 0.0), ("y", 10015, 12.0)], "source string, source_size long, target double")
    tilts = {r.of: r.tilt for r in mixing.entropy_rates(sizes, targets, 3).collect()}
    rate = lambda s, size: min(3, math.exp(tilts[s] * size))
    assert math.isclose(10 * rate("a", 10) + 60 * rate("a", 30), 120, rel_tol=1e-8)
    assert math.isclose(rate("b", 1), 0.01, rel_tol=1e-8) and tilts[None] is None and tilts["z"] is None
    assert math.isclose(15 * rate("y", 5) + 10000 * rate("y", 5000), 12, rel_tol=1e-8)


def test_mixing_carries_columns_of_the_same_names(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", "ab"[i % 2], i, i % 3, f"v{i}", f"s{i}") for i in range(60)]
    got = mixing.mix_sources(frame(spark, rows), extra=["vertex", "n_chars"]).collect()
    assert sorted((x.doc_id, x.vertex, x.n_chars) for x in got) == sorted((r[0], r[6], r[4]) for r in rows)


# chat

TURNS = "conv_id long, turn long, role string, text string, segment string, loss int"


def test_chat_round_trip(spark):
    nasty = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (1, 0, "system", "s", "", 0), (1, 1, "user", nasty, "", 0), (1, 2, "assistant", f"<!|im_end|> <!!| {nasty}\\ é😀\n", "", 0),
        (2, 1, "assistant", "first", "", 0), (2, 0, "user", None, "", 0), (3, 0, "user", "left open", "", 0),
        (4, 0, "tool\n<|x", "a", "", 0), (4, 1, "assistant", "", "", 0), (5, 5, None, "<", "", 0), (5, 5, None, "<", "", 0),
        (None, 0, "user", "q", "", 0), (None, 1, "assistant", "|", "", 0), (6, 0, "user", "x" * 200000, "", 0), (6, 1, "assistant", "y", "", 0), (6, 2, "assistant", "z", "", 0),
    ]
    segments = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    got = {x.conv_id: x for x in chat.read_back(segments.orderBy(F.rand(3))).collect()}
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2] or "", r[3] or "")):
        by[r[0]].append((r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    full = defaultdict(str)
    for s in segments.orderBy("conv_id", "segment").collect():
        full[s.conv_id] += s.text
    for conv, turns in by.items():
        x, said = got[conv], "".join(t for r, t in turns if r == "assistant")
        assert x.n_turns == len(turns) and x.loss_chars == len(said)
        assert x.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert x.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert x.formatted_chars == len(full[conv]) and full[conv].count("<|im_start|>") == len(turns)
    assert {c for c, x in got.items() if x.ok} == {1, 2, None}
    assert got[6].error == "turn 2: 'assistant' after assistant" and got[3].error is None
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0


def test_escaping_is_reversible():
    for s in ["<|", "<!|", "<!!|", "a<", "|", "<!", "\\n\n\\", "<|<!|<||"]:
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        assert chat.unescape_role(chat.escape_role(s)) == s and "\n" not in chat.escape_role(s)


# neighbours

VECTORS = "vec_id long, embedding array<float>, label int, v string, place int"


def brute(rows, k):
    fine = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine[i] = np.array(v, np.float32).astype(np.float64)
    ids = sorted(fine)
    m = np.array([fine[i] for i in ids])
    out = {}
    for n, i in enumerate(ids):
        if i % 10 == 0:
            d = np.sqrt(((m - m[n]) ** 2).sum(1))
            out[i] = [(ids[j], d[j]) for j in np.lexsort((ids, d)) if j != n][:k]
    return out


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "WINDOW_LEAST", 40)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(float).tolist(), 0, "", 0) for i in range(700)]
    same = rng.normal(size=8).tolist()
    rows += [(1000 + i, same, 0, "", 0) for i in range(60)]
    rows += [(2000, None, 0, "", 0), (2010, [0.0] * 8, 0, "", 0), (2020, [1.0] * 7 + [None], 0, "", 0), (2030, [float("nan")] * 8, 0, "", 0), (2040, [1.0] * 7, 0, "", 0), (2050, [float("inf")] * 8, 0, "", 0), (2060, [], 0, "", 0), (None, [1.0] * 8, 0, "", 0), rows[0]]
    df = spark.createDataFrame(rows, VECTORS)
    got = defaultdict(list)
    for r in neighbours.nearest(df, lambda i: i % 10 == 0, 10).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute(rows, 10)
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and q not in {v for _, v, _ in mine}
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hits += len({v for v, _ in near} & {v for _, v, _ in mine})
    assert hits >= 0.9 * 10 * len(want)
    assert [v for _, v, _ in sorted(got[1000])] == [1000 + i for i in range(1, 11)]
    assert [v for _, v, _ in sorted(got[1050])] == [1000 + i for i in range(10)]


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(i, [float(i), 1.0], 0, "", 0) for i in range(4)], VECTORS)
    got = neighbours.nearest(few, lambda i: i % 2 == 0, 10).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r.rank))] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (2, 1, 1), (2, 2, 3), (2, 3, 0)]
    assert neighbours.nearest(spark.createDataFrame([], VECTORS), lambda i: i % 2 == 0).count() == 0


def test_hilbert_curve_passes_from_cell_to_neighbouring_cell():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = neighbours.hilbert(grid.astype(np.uint64), bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# pipeline

def test_pipeline_stages(spark, tmp_path):
    rows = [r[:5] for r in documents(n=80) if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {x.doc_id for x in quality.quality_rules(docs).filter("kept").collect()}
    one = pipeline.quality(spark, docs, str(tmp_path))
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns
    from .test_dedup import groups

    left = [tuple(r) for r in one.collect()]
    two = pipeline.near_duplicates(spark, one, str(tmp_path))
    assert sorted(r.doc_id for r in two.collect()) == sorted(g[0] for g in groups(left, 5, 80) if g[1] == 0 or g[0] == g[2])
    three = pipeline.repeated_strings(spark, two, str(tmp_path))
    assert three.columns == docs.columns and three.count() == two.count()
    assert all(r.n_chars == len(r.text) for r in three.collect())
    four = pipeline.mixing(spark, three, str(tmp_path))
    copies = {x.doc_id: x.copies for x in mixing.mix_sources(three).collect()}
    assert Counter(r.doc_id for r in four.collect()) == Counter({k: v for k, v in copies.items() if v})
    # the pieces are the ids that an untouched tokenizer gives for the rows of the stage before, each row's on end
    mixed, pieces = four.collect(), pipeline.run(spark, str(tmp_path)).collect()
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = defaultdict(Counter)
    for r in mixed:
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        start = 0
        for n in binary_lengths(len(ids), 4096):
            want[r.doc_id][start, n, np.array(ids[start : start + n], "<u4").tobytes()] += 1
            start += n
    got = defaultdict(Counter)
    for p in pieces:
        got[p.doc_id][p.start, p.length, bytes(p.ids)] += 1
    assert got == want


def test_stages_keep_other_columns_whatever_their_names(spark, tmp_path):
    """Columns that the stages use for themselves, nulls in any column, repeated rows."""
    names = "doc_id long, text string, lang string, source string, n_chars long, text_key string, turn string, copies string, of string, rows string, kept_text string, block string, vertex string, size string, _host string"
    rows = [(*r[:5], *[f"{c}{r[0]}" for c in "abcdefghij"]) for r in repeated(documents(n=30))]
    rows.append((None, None, None, None, None, *[None] * 10))
    docs = spark.createDataFrame(rows, names)
    own = {tuple(r[5:]) for r in rows}
    for stage in (pipeline.quality, pipeline.near_duplicates, pipeline.repeated_strings, pipeline.mixing):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, stage
        got = [tuple(r) for r in out.collect()]
        assert got and {r[5:] for r in got} <= own
        assert all(r[5] is None or r[5] == f"a{r[0]}" for r in got)


def test_packing_stage_with_nulls_and_other_columns(spark, tmp_path):
    """Null ids, null texts, repeated rows and columns of the stage's own names: each row's ids, cut into pieces."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(*r[:5], "x", i, "y") for i, r in enumerate(repeated(documents(n=30)))] + [(None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, start int, ids string")
    want = Counter()
    for r in rows:
        ids = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 2]
        start = 0
        for n in binary_lengths(len(ids), 4096):
            want[r[0], start, n, np.array(ids[start : start + n], "<u4").tobytes()] += 1
            start += n
    assert Counter((p.doc_id, p.start, p.length, bytes(p.ids)) for p in pipeline.packing(spark, docs, str(tmp_path)).collect()) == want
    assert pipeline.packing(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_duplicates_without_or_with_equal_doc_ids(spark, tmp_path):
    """Of each group one row stays, whatever its doc_id: brute-force groups of the rows, with nulls and ids of several texts among them."""
    from .test_dedup import groups

    rows = [(r[0] if r[0] is None or i % 3 else None if i % 2 else 7, *r[1:5]) for i, r in enumerate(repeated(documents(n=80)))]
    rows += [(None, "alone without an id in its group", "en", "s", 0), (None, "  ", "en", "s", 0), (7, "alone under an id of other texts", "en", "s", 0)]
    component = [g[2] for g in groups([(i, *r[1:]) for i, r in enumerate(rows)], 5, 80)]
    empty = {i for i, r in enumerate(rows) if not WORD.search(r[1] or "")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    kept = Counter()
    for r in got:
        if WORD.search(r.text or ""):
            kept[component[next(i for i, x in enumerate(rows) if x[:2] == (r.doc_id, r.text))]] += 1
    assert kept == {component[i]: 1 for i in range(len(rows)) if i not in empty}
    least = {}
    for i, r in enumerate(rows):
        least[component[i]] = min(least.get(component[i], (True, 0)), (r[0] is None, r[0] or 0))
    at = {component[i]: x.doc_id for x in got for i, r in enumerate(rows) if r[:2] == (x.doc_id, x.text) and i not in empty}
    assert all(at[c] == (None if none else i) for c, (none, i) in least.items() if c in at)
    assert {(r.doc_id, r.text) for r in got if not WORD.search(r.text or "")} == {rows[i][:2] for i in empty}


def test_near_duplicates_deal_the_texts_once_at_the_end(spark, tmp_path):
    """the rows that stay and those that are repeated are found by one shuffle of the texts, not by one for each."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        docs = frame(spark, repeated(documents(n=20))).select("doc_id", "text", "lang", "source", "n_chars")
        plan = pipeline.near_duplicates(spark, docs, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(dealt) == 3 and not any(re.search(r"\btext#", by) for by in dealt)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as entry
    import corpus_pipeline

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert [f for _, f in corpus_pipeline.STAGES] == [pipeline.quality, pipeline.near_duplicates, pipeline.repeated_strings, pipeline.mixing, pipeline.packing]
