import hashlib
import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import blocks, jaccard, storage, substrings, suffixes
from quorumlake.llm.components import components
from quorumlake.llm.textkernel import BYTE_BASES, Prefixes, steps

from .data import SCHEMA, documents, repeated

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    """Many blocks and ranges, so that exchanges between them are exercised."""
    for module in (blocks, jaccard):
        monkeypatch.setattr(module, "BLOCK_BYTES", 9000)
    for module in (blocks, jaccard, substrings, suffixes):
        monkeypatch.setattr(module, "RANGE_HASHES", 800)
    monkeypatch.setattr(blocks.deal, "__defaults__", (9000, None))
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 20000)
    monkeypatch.setattr(jaccard, "CHUNK_ROWS", 7)
    monkeypatch.setattr(jaccard, "HOT_SIGNS", 30)


def covered_words(docs, width):
    count = Counter(tuple(w[i : i + width]) for w in docs for i in range(len(w) - width + 1))
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        yield gone


@pytest.mark.parametrize("width", [3, 12, 35])
def test_substrings_against_brute_force(spark, width):
    rows = repeated(documents())
    docs = [WORD.findall(r[1] or "") for r in rows]
    want = []
    for r, w, gone in zip(rows, docs, covered_words(docs, width), strict=True):
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = [tuple(x) for x in substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA), width).collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_a_crowded_sketch_loses_nothing(spark, monkeypatch):
    """With few counters nearly all windows are estimated repeated; the exact pass puts that right."""
    monkeypatch.setattr(substrings, "CELLS_PER_BYTE", 1e-9)
    monkeypatch.setattr(substrings, "max", lambda *a: 4 if a[0] == 20 else max(*a), raising=False)
    rows = documents()
    docs = [WORD.findall(r[1] or "") for r in rows]
    want = {r[0]: sum(g) for r, g in zip(rows, covered_words(docs, 8), strict=True)}
    got = {x.doc_id: x.n_removed for x in substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA), 8).collect()}
    assert got == want


@pytest.mark.parametrize(("length", "gram", "many"), [(60, 16, 4000), (60, 16, 0), (400, 64, 4000), (400, 64, 2)])
def test_suffixes_against_brute_force(spark, length, gram, many):
    """many 0 and 2: the pieces of all or some anchors are cut into cells."""
    rows = repeated(documents())
    raw = [(r[1] or "").encode() for r in rows]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    want = []
    for r, b in zip(rows, raw, strict=True):
        gone, end = [False] * len(b), 0
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                for k in range(max(i, end), i + length):
                    gone[k] = True
                end = i + length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((r[0], len(b), sum(gone), sum(k for k, _ in itertools.groupby(gone)), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    assert any(x[2] for x in want)
    got = [tuple(x) for x in suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA), length, gram=gram, many=many).collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize(("length", "gram", "cell"), [(60, 16, 8), (400, 64, 32)])
def test_suffixes_with_all_cells_cut_again(spark, monkeypatch, length, gram, cell):
    """Every anchor and every cell counts as hot: pieces of two windows give what whole ones do."""
    rows = repeated(documents())
    want = sorted(map(str, suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA), length, gram=gram).collect()))
    monkeypatch.setattr(suffixes, "CELL", cell)
    got = sorted(map(str, suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA), length, gram=gram, many=0).collect()))
    assert got == want


def test_a_passage_of_many_documents_makes_no_large_key():
    """Documents that share a passage in different surroundings: the distinct pieces of a key stay few as they grow in number."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    own = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage = own(600)
    largest = {}
    for n in (500, 2000, 8000):
        texts = [own(420) + passage + own(420) for _ in range(n)]
        hot = hot_cells = None
        for turn in range(3):  # anchors, cells, cells of FINE windows
            kinds, times = defaultdict(set), Counter()
            for t in steps(pa.array(texts)):
                p = suffixes.Pieces(t, 400, 64)
                if turn:
                    p.only(repeated_keys, hot, hot_cells if turn == 2 else np.zeros(0, np.uint64))
                for key, kind in zip(p.key.tolist(), p.kinds().tolist(), strict=True):
                    kinds[key].add(kind)
                    times[key] += 1
            many = np.array(sorted(k for k, v in kinds.items() if len(v) > suffixes.MANY_PIECES), np.uint64)
            if turn == 0:
                repeated_keys, hot = np.array(sorted(k for k, v in times.items() if v > 1), np.uint64), many
            hot_cells = many if turn == 1 else hot_cells
        largest[n] = max(map(len, kinds.values()))
    assert max(largest.values()) <= suffixes.MANY_PIECES, largest


def test_rows_without_ids_are_dealt_to_many_blocks(spark):
    rows = [(None if i % 2 else 7, f"text {i}", "en", "s", 0, 0, "", "") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes = [r["count"] for r in blocks.deal(docs, 16_000, 1000).groupBy("block").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 60
    got = [tuple(x) for x in jaccard.jaccard_join(docs, 4, 85).collect()]
    assert sorted(map(str, got)) == sorted(map(str, groups(rows, 4, 85)))


def test_suffixes_keep_other_columns(spark):
    rows = documents()
    got = suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA), 60, gram=16, keep=["source", "size", "block"]).collect()
    assert {(x.doc_id, x.source, x.size, x.block) for x in got} == {(r[0], r[3], r[7], r[5]) for r in rows}


def test_suffix_sort():
    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(3000)), np.uint8)
    h = Prefixes(data, BYTE_BASES[0])
    suffix = np.array(rng.sample(range(2900), 500))
    group = np.array([rng.randrange(5) for _ in range(500)])
    order = suffixes.sort_suffixes(data, h, suffix, group, 40)
    got = [(group[i], bytes(data[suffix[i] : suffix[i] + 40])) for i in order]
    assert got == sorted(got)
    extension = suffixes.common_extension(h, suffix[:-1], suffix[1:], 40)
    for i, j, n in zip(suffix[:-1], suffix[1:], extension, strict=True):
        a, b = bytes(data[i : i + 40]), bytes(data[j : j + 40])
        assert a[:n] == b[:n] and (n == 40 or a[n] != b[n])


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 1000, 777).astype(np.uint64)
    for width in (1, 2, 13, 100, 777):
        assert suffixes._sliding_min(x, width).tolist() == [int(x[i : i + width].min()) for i in range(len(x) - width + 1)]


def groups(rows, width, percent):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(lower))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return [(r[0], len(sets[i]), min(least[find(i)], default=None)) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 60), (2, 95)])
def test_jaccard_against_brute_force(spark, width, percent):
    rows = repeated(documents())
    got = [tuple(x) for x in jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA), width, percent).collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(groups(rows, width, percent), key=key)


def test_jaccard_lets_texts_go_before_what_is_found_is_dealt(spark, monkeypatch):
    """what blocks exchange, the texts and the sets that share a signature are not on disk all at one time."""
    seen, write = [], jaccard.written

    def spy(df, name):
        seen.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(jaccard, "written", spy)
    docs = spark.createDataFrame([(i, f"{'a b c d e f g h ' * 3}{i % 3}") for i in range(9)], "doc_id long, text string")
    jaccard.jaccard_join(docs, 2, 85).collect()
    plans = [said for name, said in seen if name in ("jaccard-shared", "jaccard-candidates", "jaccard-sets") and "InArrow" in said and "CoGroups" in said]
    assert [said.count("CoGroups") for said in plans] == [1, 1, 1]
    assert "shingles" in plans[2] and not re.search(r"\btext\b", plans[2])


def test_sets_that_share_signatures_alone_are_not_written(spark, monkeypatch):
    """Documents that share a passage and no more share signatures; their shingles are let go before a table holds them."""
    held, write = {}, jaccard.written

    def spy(df, name):
        out = write(df, name)
        if name == "jaccard-candidates":
            held[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", spy)
    passage = [f"w{i}" for i in range(60)]
    apart = [(i, " ".join(passage + [f"own{i}_{j}" for j in range(40)]), "en", "s", 0, 0, "", "") for i in range(30)]
    near = [(30 + i, " ".join(f"x{j}" for j in range(90 + i)), "en", "s", 0, 0, "", "") for i in range(2)]
    got = sorted(tuple(x) for x in jaccard.jaccard_join(spark.createDataFrame(apart + near, SCHEMA), 2, 85).collect())
    assert got == sorted(groups(apart + near, 2, 85)) and got[-1][2] == 30
    assert held == {"jaccard-candidates": 2}


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name for i in range(found.size()) if (name := found.apply(i).toString()).startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(name)
    table = storage.written(spark.range(1000).repartition(3, "id").groupBy("id").count(), "few")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and table.count() == 1000 and spark.conf.get(name) == was


def test_hot_signatures_meet_their_pivot_without_an_anti_join(spark):
    """Their rows grow with a group's size, are found whole, and no join has more rows than members."""
    for size in (40, 80):
        members = spark.createDataFrame([(sign, v) for v in range(size) for sign in (1, 2, 100 + v)], "sign long, vertex long")
        told = members.groupBy(F.col("sign").alias("s")).agg(F.min("vertex").alias("least"))
        hot = jaccard._hot(members)
        assert sorted(hot) == [1, 2]
        found = jaccard._with_sign(members, told, hot)
        assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r.sign, r.vertex, r.least) for r in found.collect()) == sorted((sign, v, v if sign > 2 else 0) for v in range(size) for sign in (1, 2, 100 + v))


def test_jaccard_families_of_changed_copies(spark):
    """Copies at all distances around the threshold, more of them than pivots reach."""
    rng = random.Random(9)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(40 + 60 * family)]
        for k in range(40):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                w[rng.randrange(len(w))] = f"x{family}_{k}_{rng.randrange(1000)}" if rng.random() < 0.7 else "common"
            rows.append((len(rows), " ".join(w), "en", "s", 0, 0, "", ""))
    got = sorted(tuple(x) for x in jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA), 2, 85).collect())
    assert got == sorted(groups(rows, 2, 85))
    assert 3 < len({g[2] for g in got}) < 120


def test_sets_that_share_signatures_meet_as_sketches(spark, monkeypatch):
    """of sets that share signatures and are not similar few pairs are written, and no shingles are dealt to chunks."""
    held, dealt, write = [], [], jaccard.written

    def spy(df, name):
        if "explode(" in (said := df._jdf.queryExecution().optimizedPlan().toString()) and "FlatMapGroupsInArrow" in said:
            dealt.append(said)
        out = write(df, name)
        if name == "jaccard-pairs":
            held.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", spy)
    rng = random.Random(3)
    parts = [[f"p{k}_{j}" for j in range(12)] for k in range(24)]
    rows = [(i, " ".join(w for k in rng.sample(range(24), 12) for w in parts[k]), "en", "s", 0, 0, "", "") for i in range(60)]
    rows += [(60 + i, f"{rows[7][1]} tail{i}", "en", "s", 0, 0, "", "") for i in range(3)]
    got = sorted(tuple(x) for x in jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA), 2, 85).collect())
    assert got == sorted(groups(rows, 2, 85)) and [x[2] for x in got[60:]] == [7, 7, 7]
    assert held and sum(held) < 30
    assert dealt and not any("shingles" in said for said in dealt)


def test_sketches_bound_what_sets_have_in_common():
    rng = np.random.default_rng(8)
    for percent in (10, 60, 85, 100):
        sets = [np.unique(rng.integers(0, 1 << 20, n, dtype=np.uint64)) for n in (1, 2, 30, 45, 60, 300, 420, 2000)]
        sets += [np.unique(np.append(x[len(x) // 9 :], rng.integers(0, 1 << 20, 1 + len(x) // 12, dtype=np.uint64))) for x in sets]
        n = np.array([len(x) for x in sets])
        held = jaccard.sketches(np.concatenate(sets), n, percent)
        assert all(len(b) >= 8 and len(b) * 8 * percent > 160 * k for b, k in zip(held, n.tolist(), strict=True))
        a, b = (np.array(x) for x in zip(*itertools.product(range(len(sets)), repeat=2), strict=True))
        most = jaccard.most_common([held[i] for i in a], [held[i] for i in b], n[a], n[b])
        both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
        assert (most >= both).all() and (most[a == b] == n).all()
        apart = (np.minimum(n[a], n[b]) >= 30) & (10 * both < n[a])
        assert (10 * most[apart] < 8 * np.maximum(n[a], n[b])[apart]).all()
    assert jaccard.sketches(np.zeros(0, np.uint64), np.zeros(0, np.int64), 80) == [] and not len(jaccard.most_common([], [], n[:0], n[:0]))


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 7, 12, 13, 20, 44, 150, 700):
        for _ in range(40):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            drop = int(rng.integers(0, n // 7 + 1))
            b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 7 + 1)), dtype=np.uint64)])
            both = n - drop
            if not len(b) or 100 * both < 80 * (n + len(b) - both) or (len(a) == len(b) == both):
                continue
            of, keys = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b])
            owner, sign = jaccard.signatures(of, keys, np.array([len(a), len(b)]), jaccard.Bands(80))
            assert set(sign[owner == 0].tolist()) & set(sign[owner == 1].tolist())


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (9, 9)], "a long, b long")
    got = {r.v: r.comp for r in components(links).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and got[5] == got[9] == got[3] == 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substrings.remove_repeats(none).count() == 0
    assert suffixes.remove_repeats(none).count() == 0
    assert jaccard.jaccard_join(none).count() == 0


def test_packed_integers():
    rng = np.random.default_rng(8)
    for bits in (8, 20, 40, 63):
        x = np.unique(rng.integers(0, 1 << bits, 200, dtype=np.uint64))
        assert (blocks.unpacked(blocks.packed(x)) == x).all()
    assert len(blocks.unpacked(blocks.packed(np.zeros(0, np.uint64)))) == 0
    at = blocks.cut(np.array([1, 5, 1 << 62, 1 << 63, (1 << 64) - 1], np.uint64), 4)
    assert at.tolist() == [0, 2, 3, 4, 5]
