import hashlib
import random
import zlib
from collections import Counter
from math import floor, isfinite

import numpy as np
import pytest
from prosewright.llm import bpe, variants
from prosewright.llm.bpe import Merges, codec, decode_ids, encode_texts
from prosewright.llm.centroids import cluster
from prosewright.llm.tokens import load_tokenizer
from prosewright.llm.variants import PositionIndex, count_words, group_variants, near_in_group, one_error

from .conftest import rows

NAME = "byte_bpe_50k.json"


def ids_of(text):
    return load_tokenizer(NAME).encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


# --- op11


def test_ids_and_texts_are_the_library_s(docs):
    tok = load_tokenizer(NAME)
    got = sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in encode_texts(docs, NAME, decoded=True).collect())
    want = sorted((r[0], len(ids_of(r[1])), packed(ids_of(r[1])), tok.decode(ids_of(r[1]), skip_special_tokens=False)) for r in rows())
    assert got == want


def test_random_strings_encode_as_the_library_does(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_CHARS", 5000)  # what is remembered is forgotten now and then
    parts = ["a", "the", "word", "É", "naïve", "ß", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'s", "'ll", "’", "0", "12", "½", "②", "Ⅷ", "!", "?!", "...", "-", "_", "日本", " ", "́", "\x1c", "\x85", "​"]
    parts += ["<|endoftext|>", "<|endof", "|>", "l'", "'tis", "''", "😀", "Ω", "\x00", "\x0b", "　", "﻿", " ", "aaaa", "aaaaaaaaa", "hehehe", "՘", "\U0001e030", "ⴀ", "한국어", "ไทย"]
    rng, own = random.Random(18), codec(NAME)
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(50)]
        texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 40))) for _ in range(50)]
        assert [x.hex() for x in own.encode(texts)] == [packed(ids_of(t)).hex() for t in texts]


def test_usual_words_are_mostly_right_at_once():
    own, rng = codec(NAME), random.Random(4)
    usual = " the quick brown fox jumps over a lazy dog while seven engineers carefully measure distributed throughput before lunch every other Thursday morning"
    words = [" " + w for w in usual.split()]
    ids, failing = own.merges.encode([w.encode() for w in words])
    assert failing < 0.1 * len(words) and ids == [packed(ids_of(w)) for w in words]
    odd = list({"".join(rng.choice("th er on re in at st ea nd ou".split()) for _ in range(rng.randint(1, 4))).encode() for _ in range(5000)})
    ids, failing = own.merges.encode(odd)
    assert 0 < failing < len(odd) and ids == [packed(own.merges.merge(w)) for w in odd]


def test_every_token_of_the_vocabulary_is_found_sound_or_not():
    m = codec(NAME).merges
    sound = m.sound()
    for t in [*range(0, 50256, 97), *range(300)]:
        assert sound[t] == (m.merge(m.bytes[t]) == [t])


def test_pairs_are_compatible_if_exact_merging_keeps_them_apart():
    m, rng = codec(NAME).merges, random.Random(3)
    tokens = np.flatnonzero(m.sound()[:3000]).tolist()
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(4000)] + [(t, t) for t in tokens]
    got = m.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [m.merge(m.bytes[a] + m.bytes[b]) == [a, b] for a, b in pairs]


def test_merges_with_ties_and_unsound_tokens():
    byte = {bpe._SPELLED.get(b, b): b for b in range(256)}
    vocab = {chr(c): b for c, b in byte.items()}
    merges = [("a", "b"), ("b", "c"), ("a", "bc"), ("ab", "ab"), ("a", "a"), ("aa", "aa"), ("abab", "c")]  # "abc" is never made of its own bytes
    for i, (a, b) in enumerate(merges):
        vocab[a + b] = 256 + i
    m = Merges(vocab, [" ".join(p) for p in merges])
    assert not m.sound()[vocab["abc"]] and m.sound()[vocab["abab"]]
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))).encode() for _ in range(3000)]

    def slowly(word):
        ids, rank = [vocab[c] for c in word.decode()], {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(merges)}
        while found := [(rank[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]:
            r, i = min(found)
            ids[i : i + 2] = [256 + r]
        return ids

    assert m.encode(words)[0] == [packed(slowly(w)) for w in words]
    with pytest.raises(ValueError):
        Merges(vocab, [("a", "b"), ("a", "b")])


def test_characters_taken_as_agreed_are_cut_as_the_library_does():
    own = codec(NAME)
    for c in range(0x20000):
        if not 0xD800 <= c < 0xE000 and not own.odd.search(ch := chr(c)):
            s = f"a{ch}1{ch}!{ch} {ch}{ch}"
            assert own.word.findall(s) == [s[a:b] for _, (a, b) in own.tok.pre_tokenizer.pre_tokenize_str(s)], hex(c)


def test_ids_decode_as_the_library_does(spark):
    tok, own, rng = load_tokenizer(NAME), codec(NAME), random.Random(9)
    lists = [[rng.choice([rng.randrange(50257), rng.randrange(256), 50256]) for _ in range(rng.randint(0, 30))] for _ in range(500)]
    assert [own.decode(packed(x)) for x in lists] == [tok.decode(x, skip_special_tokens=False) for x in lists]
    frame = spark.createDataFrame([(i, bytearray(packed(x))) for i, x in enumerate(lists)] + [(-1, None)], "doc_id long, ids binary")
    got = {r["doc_id"]: r["text"] for r in decode_ids(frame, NAME).collect()}
    assert got == {i: tok.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)} | {-1: ""}


def test_very_long_texts_and_words(spark, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP_CHARS", 10_000)
    monkeypatch.setattr(bpe, "BATCH_BYTES", 50_000)
    texts = ["some words, and more: 12 naïve\n\n" * 3000, "z" * 60_000, " " * 30_000 + "x", "abcab" * 8000, None, ""]
    got = encode_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), NAME, decoded=True).collect()
    assert {r["doc_id"]: (bytes(r["ids"]), r["decoded"]) for r in got} == {i: (packed(ids_of(t)), t or "") for i, t in enumerate(texts)}


def test_encoding_odd_tables(empty, odd):
    assert encode_texts(empty, NAME).count() == 0 and encode_texts(odd, NAME).count() == 3


# --- op12


def slow_counts(data, one_in):
    total = Counter()
    for r in data:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
                total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
                run = ""
    return total


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def slow_variants(total, min_chars=5, min_count=3):
    n = {w: k for w, k in total.items() if len(w) >= min_chars and k >= min_count}
    form, near = {}, {}
    for w in n:
        own = [v for v in n if apart(w, v)]
        near[w] = len(own)
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return sorted(out)


def spelled(seed, words=260, letters="abé"):
    """Rows of texts over few letters, so that most words have neighbours, with counts that make chains of forms."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(words)]
    weight = [2 ** rng.randint(0, 7) for _ in vocabulary]
    texts = [" ".join(w.capitalize() if rng.random() < 0.2 and w[0] != "é" else w for w in rng.choices(vocabulary, weight, k=200)) for _ in range(40)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, None), (4, ""), (5, texts[1]), (5, texts[1]), (6, "Été été ÉTÉ × ÷ÿÿÿÿÿ don't x_y_z")]


@pytest.mark.parametrize(("seed", "group_words"), [(1, 8192), (2, 8), (3, 1)])
def test_variants_equal_brute_force(spark, seed, group_words):
    data = spelled(seed)
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in group_variants(frame, one_in=7, group_words=group_words).collect())
    want = slow_variants(slow_counts(data, 7))
    assert got == want
    assert sum(r[4] for r in want) > 300 and any(r[1] and r[2] != r[1] for r in want)


def test_given_rows_equal_brute_force(docs):
    got = sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in group_variants(docs).collect())
    assert got == slow_variants(slow_counts(rows(), 97)) and got


@pytest.mark.parametrize(("min_chars", "letters"), [(1, "ab"), (2, "abc")])
def test_short_words_too(spark, min_chars, letters):
    rng = random.Random(min_chars)
    data = [(i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(300))) for i in range(5)]
    got = sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in group_variants(spark.createDataFrame(data, "doc_id long, text string"), min_chars=min_chars, group_words=6).collect())
    assert got == slow_variants(slow_counts(data, 97), min_chars)


def test_recurrence_tells_replaced_and_added_letters():
    same, longer = PositionIndex(["abc", "abd", "xbc", "xyc", "bbc"], 3), PositionIndex(["abbc", "aabc", "abcd", "abxc", "axbd", "xabc"], 4)
    replaced, more = one_error("abc", same, longer, at_end=True)
    assert replaced == 0b10110 and more == 0b101111
    assert one_error("abc", same, longer, at_end=False) == (0b10110, 0b101011)


def test_pairs_of_a_group_are_found_once_by_third():
    words = ["aaaaaa", "aaaaaaa", "aaaaab", "abaaaa", "aabaaaa"]
    for bounds in ([0, 2, 4, 6], [0, 1, 2, 3, 4, 5, 6]):
        found = []
        for x, y in zip(bounds, bounds[1:], strict=False):
            groups = {}
            for w in words:
                groups.setdefault((w[:x], w[len(w) - 6 + y :]), []).append((w, 1))
            found += [(a, b) for g in groups.values() for a, b, _ in near_in_group(g, 6, x, y)]
        assert sorted(found) == sorted((a, b) for a in words for b in words if apart(a, b) and 6 in (len(a), len(b)))


def test_words_of_long_texts_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(variants, "CHUNK", 50)
    text = "wordy " * 100 + "q" * 300 + " Ünder-wordy\x00wordy"
    frame = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    got = {r["word"]: r["n"] for r in count_words(frame).collect()}
    assert got == {w: n for w, n in slow_counts([(1, text), (2, text)], 97).items() if len(w) >= 5}


def test_variants_of_odd_tables(empty, odd):
    assert group_variants(empty).count() == 0
    assert [r["word"] for r in group_variants(odd, min_count=1).orderBy("word").collect()] == ["other", "there", "words"]


# --- op13


def slow_clusters(data, clusters, rounds, dim):
    kept = [(i, [floor(256 * float(x)) for x in v]) for i, v in data if v and len(v) == dim and all(x is not None and isfinite(x) for x in v)]
    centre = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))][:clusters]
    choose = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centre))
    for _ in range(rounds):
        mine = [choose(v)[1] for _, v in kept]
        for k in range(len(centre)):
            if own := [v for (_, v), m in zip(kept, mine, strict=True) if m == k]:
                centre[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, *choose(v)[::-1]) for i, v in kept]
    return sorted(
        ((i, k, d, sum(r[2] for r in out if r[1] == k), sum(r[2] for r in out), hashlib.sha256(",".join(map(str, centre[k])).encode()).hexdigest()) for i, k, d in out),
        key=str,
    )


VECTORS = "vec_id long, embedding array<float>, label int, cluster string, distance double"


def as_rows(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize(("clusters", "rounds"), [(5, 5), (40, 2), (3, 0)])
def test_clusters_equal_brute_force(spark, clusters, rounds):
    rng = np.random.default_rng(clusters)
    data = [(i, [float(np.float32(x)) for x in rng.normal(size=6) + 3 * (i % 4)]) for i in range(120)]
    data += [(200 + i, data[0][1]) for i in range(6)] + [(7, data[7][1]), (7, data[8][1]), (None, data[3][1])]  # ties, copies, repeated ids
    data += [(300, None), (301, []), (302, [0.0] * 5), (303, [0.0] * 5 + [None]), (304, [0.0] * 5 + [float("nan")]), (305, [0.0] * 5 + [float("inf")]), (306, [0.0] * 6)]
    frame = spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in data], VECTORS).repartition(3)
    assert as_rows(cluster(frame, clusters, rounds, 6)) == slow_clusters(data, clusters, rounds, 6)


def test_fewer_vectors_than_clusters_and_none(spark):
    data = [(1, [0.5] * 4), (2, [-0.5] * 4)]
    assert as_rows(cluster(spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in data], VECTORS), dim=4)) == slow_clusters(data, 40, 5, 4)
    assert cluster(spark.createDataFrame([], VECTORS)).collect() == []


def test_numbers_beyond_the_bound_are_held_there(spark):
    frame = spark.createDataFrame([(1, [3e38] * 64, 1, "x", 0.5), (2, [-3e38] * 64, 1, "x", 0.5)], VECTORS)
    got = {r["vec_id"]: r for r in cluster(frame, clusters=1, rounds=0).collect()}
    assert sorted(r["distance"] for r in got.values()) == [0, 64 << 56] and got[1]["inertia"] == 64 << 56
    more = spark.createDataFrame([(i, [3e38 if i % 2 else -3e38] * 64, 1, "x", 0.5) for i in range(8)], VECTORS)
    assert {r["inertia"] for r in cluster(more, clusters=1, rounds=0).collect()} == {None}
