import random
import zlib

import numpy as np
import pytest
from prosewright.llm import packing
from prosewright.llm.packing import Encoder, SumOfSquares, cut_to_fit, pack
from prosewright.llm.tokens import byte_balanced, count_tokens, load_tokenizer, safe_pieces

from .conftest import rows

NAME = "byte_bpe_50k.json"


def ids_of(text):
    return load_tokenizer(NAME).encode(text or "", add_special_tokens=False).ids


def test_counts_are_the_library_s(docs):
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in count_tokens(docs, NAME).collect())
    assert got == sorted((r[0], len((r[1] or "").encode()), len(ids_of(r[1]))) for r in rows())


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_pieces_encode_as_the_whole(size):
    for text in [r[1] for r in rows() if r[1]] + ["a  b\n\n c\t d", "  lead", "trail  ", "don't we'll   stop\r\n", "　 \x85 x"]:
        assert "".join(safe_pieces(text, size)) == text
        assert [i for p in safe_pieces(text, size) for i in ids_of(p)] == ids_of(text)


def test_pieces_pack_back_to_the_texts(docs):
    pieces = pack(docs, NAME).collect()
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_window.setdefault(p["sequence_id"], []).append(p)
    want = {}
    for r in rows():
        want.setdefault(r[0], []).append(ids_of(r[1]) + [0])
    assert set(by_doc) == set(want)
    for doc, own in by_doc.items():
        if len(want[doc]) > 1:
            assert sum(p["length"] for p in own) == sum(map(len, want[doc]))
            continue
        ids, at = want[doc][0], 0
        for p in sorted(own, key=lambda p: p["start"]):
            part = ids[at : at + p["length"]]
            assert (p["start"], p["doc_tokens"]) == (at, len(ids)) and p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in by_window.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 1024 or at & (at - 1) == 0


def test_ids_are_the_library_s_for_odd_strings(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_CHARS", 3000)  # what is remembered is forgotten now and then
    parts = ["a", "the", "word", "É", "naïve", "ß", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'s", "'ll", "’", "0", "12", "½", "②", "Ⅷ", "!", "?!", "...", "-", "_", "日本", "\u00a0", "\u0301", "\x1c", "\x85", "\u200b"]
    parts += ["<|endoftext|>", "<|endof", "|>", "l'", "'tis", "''", "d'eau", "\n's", "😀", "Ω", " x", "x ", "\x00", "\x0b", "\x0c", "\u3000", "\ufeff", "\u2028"]
    rng, encoder = random.Random(8), Encoder(NAME)
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert encoder.ids(text).tolist() == ids_of(text), repr(text)


def test_texts_over_a_part_encode_as_the_whole(spark, monkeypatch):
    text = "some words, and more: 12 naïve\n\n" * 1500 + "z" * 40_000 + " end"
    assert len(text) > 16_384 * 5
    row = count_tokens(spark.createDataFrame([(1, text), (2, " " * 40_000)], "doc_id long, text string"), NAME).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in row} == {1: (len(text.encode()), len(ids_of(text))), 2: (40_000, len(ids_of(" " * 40_000)))}
    monkeypatch.setattr(packing, "PART_CHARS", 1000)
    assert Encoder(NAME).ids(text).tolist() == ids_of(text)


def test_calls_are_balanced_by_bytes():
    pieces = ["a" * 50, "日" * 50, "é" * 10, "b" * 30, "日" * 40]
    size = [[len(pieces[i].encode()) for i in g] for g in byte_balanced(pieces, 100)]
    assert [sum(s[:-1]) < 100 <= sum(s) for s in size[:-1]] == [True] * (len(size) - 1) and sum(map(len, size)) == 5


@pytest.mark.parametrize("parts", [1, 6, 40])
def test_few_tokens_are_placed_by_the_final_cut(spark, parts):
    rng = random.Random(parts)
    own = [(i, " ".join(rng.choice(["and", "the", "word", "of"]) for _ in range(int(rng.lognormvariate(6, 1.1)) + 1))) for i in range(400)]
    pieces = pack(spark.createDataFrame(own, "doc_id long, text string").repartition(parts), NAME).collect()
    assert sum(p["length"] for p in pieces if p["by_cut"]) <= 0.06 * sum(p["length"] for p in pieces)
    size = {}
    for p in pieces:
        size[p["sequence_id"]] = size.get(p["sequence_id"], 0) + p["length"]
    assert sum(s < 1024 for s in size.values()) <= 10 and all(s & (s - 1) == 0 for s in size.values())


def test_packers_of_open_windows_take_any_share(spark):
    own = [(i, "word " * (i * 37 % 900)) for i in range(150)]
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(5)
    one, many = (sorted((p["doc_id"], p["start"] + i) for p in pack(docs, NAME, tokens_a_packer=n).collect() for i in range(p["length"])) for n in (1 << 24, 5000))
    assert one == many == sorted((i, k) for i, t in own for k in range(len(ids_of(t)) + 1))


def test_cutting_empties_the_emptiest_windows():
    windows = [(n, [(n, 0, np.arange(n, dtype="<u4"), n)]) for n in (900, 1000, 300, 700, 64)]
    out = list(cut_to_fit(windows, 1024))
    assert [sum(len(p[2]) for p in w) for w in out] == [1024, 1024, 512, 256, 128, 16, 4]
    assert [w[0][0] for w in out[:2]] == [1000, 900] and not out[0][0][4] and out[0][1][4]
    for n in (900, 1000, 300, 700, 64):
        assert np.concatenate([p[2] for w in out for p in sorted(w, key=lambda p: p[1]) if p[0] == n]).size == n


def test_the_level_that_keeps_squares_least():
    packer = SumOfSquares(10)
    packer.level[[3, 4, 6]] = [2, 1, 3]

    def cost(level, size):
        n = packer.level.copy()
        if level:
            n[level] -= 1
        if level + size < 10:
            n[level + size] += 1
        return int((n**2).sum())

    for size in range(1, 10):
        usable = [h for h in (0, 3, 4, 6) if h + size <= 10]
        best = packer.best_level(size)
        assert best in usable and cost(best, size) == min(cost(h, size) for h in usable)


def test_empty_and_odd_tables(empty, odd):
    assert count_tokens(empty, NAME).count() == 0 and pack(empty, NAME).count() == 0
    assert count_tokens(odd, NAME).count() == 3
    assert sorted(p["length"] for p in pack(odd, NAME).collect())[0] == 1
