import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quorumlake.llm import token_files
from quorumlake.llm.packing import binary_lengths, pack_documents
from quorumlake.llm.textkernel import BYTE_BASES, PRIME, WORD_BASES, Prefixes, slice_hashes, steps, times, windows
from quorumlake.llm.token_files import decode_ranks, encode_ranks, read_token_files, token_file_path, write_token_files
from quorumlake.llm.tokens import PartTable, PieceEncoder

from .data import SCHEMA, alike, documents, repeated

P = pytest.importorskip("public_tokenizers")
FILES = {"words": "word_bpe_49k.json", "bytes": "byte_bpe_50k.json"}


def reference(kind):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(FILES[kind]))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_words_are_runs_of_other_bytes():
    texts = ["a  b\tc", "", None, " x\x0b\x0cy ", "é　ñ z\x1cq"]
    found = [(d, bytes(t.data[s:e]).decode()) for t in steps(pa.array(texts)) for s, e, d in zip(*t.words(), strict=True)]
    assert found == [(i, w) for i, x in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", x or "")]


def test_windows_equal_only_for_equal_words():
    (t,) = steps(pa.array(["a b c d", "x a b c", "a b", "ab c d"]))
    at, keys = windows(t.word_hashes(), t.words()[2], 3)
    words = [bytes(t.data[s:e]) for s, e in zip(*t.words()[:2], strict=True)]
    by_key = {}
    for a, k in zip(at.tolist(), keys.tolist(), strict=True):
        assert by_key.setdefault(k, words[a : a + 3]) == words[a : a + 3]
    assert len(by_key) == 4 and len(at) == 5


def test_prefix_hashes_against_plain_integers():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, PRIME, 500, dtype=np.uint64), rng.integers(0, PRIME, 500, dtype=np.uint64)
    a[:3], b[:3] = PRIME - 1, [0, 1, PRIME - 1]
    assert times(a, b).tolist() == [x * y % PRIME for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    for values, base in ((rng.integers(0, 256, 3000).astype(np.uint8), BYTE_BASES[0]), (rng.integers(0, 1 << 64, 3000, dtype=np.uint64), WORD_BASES[1])):
        plain = [int(v) + (values.dtype == np.uint8) for v in values]
        start, end = np.array([0, 5, 5, 17, 2999]), np.array([3000, 5, 6, 2000, 3000])
        want = [sum(v * pow(base, i, PRIME) for i, v in enumerate(plain[s:e])) % PRIME for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        assert Prefixes(values, base).of(start, end).tolist() == want
    many = rng.integers(0, 256, (1 << 22) + 9).astype(np.uint8)  # beyond what the quick way for bytes takes
    h = Prefixes(many, BYTE_BASES[0])
    assert h.of(np.array([len(many) - 9]), np.array([len(many)])) == Prefixes(many[-9:], BYTE_BASES[0]).of(np.array([0]), np.array([9]))


def test_words_that_sums_of_powers_confuse():
    for bits in (6, 10, 11, 12):
        raw = "".join(alike(bits)).encode()
        data, n = np.frombuffer(raw, np.uint8), 1 << bits
        for which in (0, 1):
            a, b = slice_hashes(data, np.array([0, n]), np.array([n, 2 * n]), which)
            assert a != b
        a, b = Prefixes(data, BYTE_BASES[0]).of(np.array([0, n]), np.array([n, 2 * n]))
        assert a != b
        words = np.where(data == 97, np.uint64(0x123456789ABCDEF1), np.uint64(0xFEDCBA987654321F))
        assert len(set(windows(words, np.zeros(len(words), np.int64), n)[1][[0, n]].tolist())) == 2


@pytest.mark.parametrize("kind", FILES)
def test_parts_give_the_ids_of_whole_texts(kind):
    rng = random.Random(11)
    alphabet = " \n\t'.,aB1é　  ñ漢_sSt́Tİİ-\x1c\x85😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["a  b", "  x", "it's 'll 12.5,3", "<|endoftext|> a", "\n", "x\n\ny\n z", " a .b", "rock'n'roll.. ...", "ΑΣ ΣΑΣ."]
    texts += ["c" * 8 + x for bits in (4, 7, 11) for x in alike(bits)] * 2 + ["d" * k + "e" for k in (254, 255, 256, 300)] * 2
    own, ids_of = PieceEncoder(P.path(FILES[kind]), kind), reference(kind)
    got = []
    for t in steps(pa.array(texts), 2000):
        ids, counts = own.encode(t)
        got += np.split(ids, np.cumsum(counts)[:-1])
    assert [g.tolist() for g in got] == [ids_of(x) for x in texts]


@pytest.mark.parametrize("kind", FILES)
def test_added_tokens_as_in_the_plain_call(spark, kind):
    """Against an untouched tokenizer: strings of added tokens in texts, in other case, cut short and over a text's end."""
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(P.path(FILES[kind])), random.Random(5)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<", " ", "\n", "a", "É", "e\u0301", "\u0301", "'s", "7", "\u3000", "<|endo\nftext|>"]
    texts = ["a <|endoftext|> b", "<|endo", "ftext|>", None, "", "<|endoftext|>"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(2000)]
    want = [plain.encode(x or "", add_special_tokens=False).ids for x in texts]
    own, got = PieceEncoder(P.path(FILES[kind]), kind, added=True), []
    for t in steps(pa.array(texts), 2000):
        ids, counts = own.encode(t)
        got += np.split(ids, np.cumsum(counts)[:-1])
    assert [g.tolist() for g in got] == want
    rows = [(i, x, "en", "s", 0, 0, "", "") for i, x in enumerate(texts[:40])]
    packed = {(p.doc_id, p.start): list(np.frombuffer(p.ids, "<u4")) for p in pack_documents(spark.createDataFrame(rows, SCHEMA), P.path(FILES[kind]), kind, 2, 4096).collect()}
    for i, ids in enumerate(want[:40]):
        assert sum((packed[k] for k in sorted(packed) if k[0] == i), []) == [*ids, 2]


def test_part_table_holds_what_was_added():
    rng = np.random.default_rng(3)
    table, keys = PartTable(1000), rng.integers(0, 1 << 60, 1000, dtype=np.uint64) << np.uint64(4)
    keys[500:] = keys[:500]  # equal hashes, other checks
    checks = np.arange(1000, dtype=np.uint64)
    table.add(keys[:700], checks[:700], np.arange(700))
    table.add(keys[700:], checks[700:], np.arange(700, 1000))
    assert (table.find(keys, checks) == np.arange(1000)).all()
    assert (table.find(keys, checks + np.uint64(5000)) == -1).all()


def test_binary_lengths():
    for n in [1, 2, 3, 7, 8, 4095, 4096, 4097, 10000, 12288]:
        got = binary_lengths(n, 4096)
        assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 and x <= 4096 for x in got)
        assert len([x for x in got if x < 4096]) == bin(n % 4096).count("1")


def test_rank_coding_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.random(n) ** 8 * 2**32).astype(np.uint32)
        control, data = encode_ranks(ranks)
        assert len(control) == -(-n // 4)
        assert (decode_ranks(control, data, n) == ranks).all()
    assert len(encode_ranks(np.zeros(8, np.uint32))[1]) == 8


def test_packing(spark):
    rows = repeated(documents())
    pieces = pack_documents(spark.createDataFrame(rows, SCHEMA), P.path(FILES["words"]), "words", 2, 64).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces) and all(p.offset == 0 for p in pieces)
    ids_of, texts = reference("words"), [(r[0], r[1]) for r in rows]
    by_doc: dict = {}
    for p in sorted(pieces, key=lambda p: p.sequence_id):
        assert p.length & (p.length - 1) == 0 and p.length <= 64 and len(p.ids) == 4 * p.length
        by_doc.setdefault(p.doc_id, []).append(p)
    for doc_id, text in texts:
        want = [*ids_of(text), 2]
        own = [p for p in by_doc[doc_id] if p.doc_tokens == len(want)]
        got = np.concatenate([np.frombuffer(p.ids, "<u4") for p in sorted(own, key=lambda p: p.start)])
        copies = texts.count((doc_id, text))
        assert sorted(got.tolist()) == sorted(want * copies)
        if copies == 1:
            assert got.tolist() == want
    assert pack_documents(spark.createDataFrame([], SCHEMA), P.path(FILES["words"])).count() == 0


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    rows = repeated(documents())
    path = token_file_path(spark)
    write_token_files(spark.createDataFrame(rows, SCHEMA), path, P.path(FILES["bytes"]), "bytes", 0)
    got = read_token_files(spark, path).collect()
    ids_of = reference("bytes")
    want = sorted((r[0] if r[0] is not None else -1, zlib.crc32(np.array([*ids_of(r[1]), 0], "<u4").tobytes())) for r in rows)
    assert sorted((g.doc_id if g.doc_id is not None else -1, zlib.crc32(g.ids)) for g in got) == want
    start = 0
    for g in sorted(got, key=lambda g: g.start):
        assert g.start == start and 4 * g.n_tokens == len(g.ids)
        start += g.n_tokens
    ids = [g.doc_id if g.doc_id is not None else -1 for g in sorted(got, key=lambda g: g.start)]
    assert ids == sorted(ids)
    ranks = {r.rank: r.n for r in spark.read.parquet(f"{path}/ranks").collect()}
    assert [ranks[i] for i in sorted(ranks)] == sorted(ranks.values(), reverse=True)
    empty = token_file_path(spark)
    write_token_files(spark.createDataFrame([], SCHEMA), empty, P.path(FILES["bytes"]))
    assert read_token_files(spark, empty).count() == 0
