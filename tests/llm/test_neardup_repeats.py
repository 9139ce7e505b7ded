import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from prosewright.llm.common import Scratch
from prosewright.llm.graph import components
from prosewright.llm.neardup import COORDINATES, _block_links, _part, _parts, band_keys, band_width, compare_buckets, confirm, near_duplicates, sketches, without_near_duplicates
from prosewright.llm.repeats import CHUNK, repeated_bytes, segments, without_repeats
from prosewright.llm.rlindex import RunLengthIndex, earlier_matches
from prosewright.llm.shingles import shingle_sets
from pyspark.sql import functions as F

from .conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected_components(own, percent=85):
    sets = {i: shingles_of(t) for i, t in own}
    comp = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return sets, comp


def test_shingle_sets_have_the_sizes_of_word_sets():
    texts = [r[1] or "" for r in rows()] + ["a b c d", "a b c d e", "A B c D e f a b c d e"]
    assert [len(s) for s in shingle_sets([t.encode() for t in texts])] == [len(shingles_of(t)) for t in texts]


def test_components_are_those_of_all_pairs(docs):
    got = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    sets, comp = expected_components({(r[0], r[1]) for r in rows()})
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}
    kept = {r["doc_id"] for r in without_near_duplicates(docs).collect()}
    assert kept == {i for i in sets if comp[i] == i}


def test_every_coordinate_fills_and_agrees_as_often_as_the_sets():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 900, dtype="u8")
    table = sketches([base[:1], base[:3], base[:800], base[100:], base[:0]])
    assert (table[:4] >> np.uint64(53) < 2 * COORDINATES).all() and (table[4] == np.iinfo("u8").max).all()
    assert abs((table[2] == table[3]).mean() - 700 / 900) < 0.12
    assert band_keys(table, 6).shape == (5, 36) and band_keys(table, 5).shape == (5, 43)
    assert (band_width(85), band_width(80)) == (6, 5)
    assert (sketches([base[:3]])[0] == table[1]).all()


def test_large_buckets_are_compared_in_full(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(40):
        w = list(base)
        for j in rng.sample(range(100), i % 7):
            w[j] = f"x{i}.{j}"
        texts.append((i, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    members = spark.createDataFrame([(1, 40, 0, i, 20_000, i) for i, _ in texts], "key long, cnt long, part int, doc_id long, n_shingles long, component long")  # so two blocks
    links = compare_buckets(members, docs)
    found = {r["node"]: r["component"] for r in components(links, Scratch(spark, "t"), "c").collect()}
    _, comp = expected_components(texts)
    assert {i: found.get(i, i) for i in comp} == comp


def test_common_keys_are_dealt_in_parts(spark):
    rng = random.Random(14)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(700):  # one bucket of near copies that are each linked with the smallest
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        texts.append((i, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    pairs = spark.createDataFrame([(0, i, 699) for i in range(1, 700)], "a long, b long, near long")
    parts = pairs.select(_part("b", _parts(F.col("near"), 64)).alias("p")).groupBy("p").count().collect()
    assert len(parts) == 16 and max(r["count"] for r in parts) < 100
    assert {(r["u"], r["v"]) for r in confirm(pairs, docs, 60).collect()} == {(0, i) for i in range(1, 700)}
    assert {r["component_id"] for r in near_duplicates(docs, 70).collect()} == {0}


def test_of_repeated_rows_one_stays(spark):
    own = [(1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (2, "seven eight nine ten eleven twelve", None), (2, "other words of the same id", "b"), (None, "x y z", "c"), (None, "x y z", "c"), (3, None, "d"), (3, None, "d")]
    docs = spark.createDataFrame(own, "doc_id long, text string, _id string")
    kept = sorted(map(repr, without_near_duplicates(docs).collect()))
    assert kept == sorted(map(repr, docs.limit(8).collect()[:1] + docs.collect()[2:7]))


def test_texts_over_a_chunk_are_compared_whole(spark):
    rng = random.Random(31)
    words = [f"word{rng.randrange(10**6)}" for _ in range(110_000)]  # over a mebibyte
    other = words[:100_000] + [f"other{i}" for i in range(5_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:60_000]))], "doc_id long, text string")
    assert len(" ".join(words)) > 1 << 20
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()} == {1: (109_996, 1), 2: (104_996, 1), 3: (59_996, 3)}


def test_block_links_span_components():
    sets = shingle_sets([b"a b c d e f g h", b"a b c d e f g h", b"q r s t u v"])
    assert _block_links([5, 6, 7], [5, 6, 7], sets, [0, 0, 0], 85) == [(5, 6)]
    assert _block_links([5, 6, 7], [5, 6, 7], sets, [0, 1, 1], 85) == [(5, 6)]
    assert _block_links([5, 6], [5, 5], sets[:2], [0, 0], 85) == []


def test_chains_and_stars_become_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 199)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "c").collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 130)} | {199: 199, 200: 199}


def removed(own, depth=100):
    seen, out = set(), {}
    for doc, text in sorted(own):
        raw = (text or "").encode()
        mark = np.zeros(len(raw), bool)
        for o in range(len(raw) - depth + 1):
            if raw[o : o + depth] in seen:
                mark[o : o + depth] = True
            seen.add(raw[o : o + depth])
        out[doc] = (raw, mark)
    return out


def test_repeats_are_those_of_all_windows(docs):
    own = {(r[0], r[1]) for r in rows()}
    got = {r["doc_id"]: r for r in repeated_bytes(docs).collect()}
    cleaned = {r["doc_id"]: r for r in without_repeats(docs).collect()}
    assert sum(m.sum() for _, m in removed(own).values()) > 5000
    for doc, (raw, mark) in removed(own).items():
        kept = bytes(np.frombuffer(raw, "u1")[~mark])
        spans = int((np.diff(mark.astype("i1"), prepend=0) == 1).sum())
        assert (got[doc]["n_bytes"], got[doc]["n_removed"], got[doc]["n_spans"]) == (len(raw), mark.sum(), spans)
        assert got[doc]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert (cleaned[doc]["text"] or "") == kept.decode("utf-8", "ignore")


def test_rows_that_share_an_id_or_have_none_are_cut_each_by_their_own_marks(spark):
    rng = random.Random(12)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    passage = text(150, "abcdef ")
    for shared in (None, 5):
        own = [(1, passage), (shared, text(300, "ghijkl ")), (shared, text(300, "mnopqr ")), (9, passage + text(50, "stuvwx ")), (shared, text(100, "yz01 ") + passage)]
        docs = spark.createDataFrame(own, "doc_id long, text string")
        kept = sorted(r["text"] for r in without_repeats(docs).collect())
        # a null id comes before all others, 5 after 1
        want = {1: "" if shared is None else passage, 9: own[3][1][150:], 0: own[4][1] if shared is None else own[4][1][:100]}
        assert kept == sorted([want[1], own[1][1], own[2][1], want[9], want[0]])
        assert sorted(r["n_removed"] for r in repeated_bytes(docs).collect()) == [0, 0, 0, 150, 150]


def test_common_borders_are_cut_into_windows(spark, monkeypatch):
    import prosewright.llm.repeats as repeats

    monkeypatch.setattr(repeats, "MOST_SEGMENTS", 3)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdef ") for _ in range(160))
    own = [(i, "".join(rng.choice("ghijkl ") for _ in range(rng.randint(0, 90))) + passage + "".join(rng.choice("mnopqr ") for _ in range(rng.randint(0, 90)))) for i in range(25)]
    got = {r["doc_id"]: r["n_removed"] for r in repeats.repeated_bytes(spark.createDataFrame(own, "doc_id long, text string")).collect()}
    assert got == {doc: int(m.sum()) for doc, (_, m) in removed(own).items()}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=8), st.sampled_from([6, 9, 16, 25]))
def test_index_finds_earlier_matches(strings, depth):
    where = np.cumsum([0] + [len(s) + 1 for s in strings])[:-1]
    seen, want = {}, []
    for s, p in zip(strings, where, strict=True):
        for o in range(len(s) - depth + 1):
            seen.setdefault(s[o : o + depth], p + o)
    for s, p in zip(strings, where, strict=True):
        want.append([o for o in range(max(0, len(s) - depth + 1)) if seen[s[o : o + depth]] < p + o])
    assert [f.tolist() for f in earlier_matches(strings, where, depth)] == want


def test_index_keeps_three_numbers_a_run_and_repetition_shortens_it():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(2000))
    once, often = RunLengthIndex([text]), RunLengthIndex([text] * 20)
    assert len(once.at) == len(once.to) == len(once.shared) <= 2001
    assert len(often.at) < 2 * len(once.at)  # 20 times the text
    position, before = often.linked(100)
    own = often.text.tobytes()
    assert len(position) == 19 * 1901 and all(own[a : a + 100] == own[b : b + 100] for a, b in zip(position[::97], before[::97], strict=True))


def test_texts_over_a_chunk_are_read_whole(spark):
    rng = random.Random(21)
    long_text = "".join(rng.choice("abcdefghij klmno") for _ in range(CHUNK + 3000))
    at = CHUNK - 60  # across the border of two chunks
    own = [(1, long_text), (2, "x" * 30 + long_text[at : at + 130] + "y" * 30), (3, long_text[-140:]), (4, "é" * 300)]
    got = {r["doc_id"]: r for r in repeated_bytes(spark.createDataFrame(own, "doc_id long, text string")).collect()}
    want = {doc: int(m.sum()) for doc, (_, m) in removed(own[1:]).items()}
    assert got[1]["n_removed"] == 0 and got[1]["n_bytes"] == CHUNK + 3000
    assert (got[2]["n_removed"], got[3]["n_removed"], got[4]["n_removed"]) == (130, 140, want[4])


def test_many_rows_of_one_id_and_text_make_one_list_of_marks(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    own = [(None, "before " + passage)] * 300 + [(1, passage)]
    got = repeated_bytes(spark.createDataFrame(own, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 301 and {(r["doc_id"], r["n_removed"]) for r in got} == {(None, 0), (1, len(passage))}


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(300))
    texts = [bytes(rng.choice(b"xyz ") for _ in range(n)) + passage for n in (0, 37, 180)]
    seen = []
    for t in texts:
        anchor, first, windows = segments(np.frombuffer(t, "u1"), np.array([len(t)]))
        of = {}
        for a, f, n in zip(anchor, first, windows, strict=True):
            of |= {t[i : i + 100]: a for i in range(f, f + n)}
        assert len(of) == len({t[i : i + 100] for i in range(len(t) - 99)})
        seen.append(of)
    assert all(seen[0][w] == seen[1][w] == seen[2][w] for w in (passage[i : i + 100] for i in range(201)))


@pytest.mark.parametrize("work", [near_duplicates, without_near_duplicates, repeated_bytes, without_repeats])
def test_empty_and_odd_tables(work, empty, odd):
    assert work(empty).count() == 0
    assert work(odd).count() == 3


def test_equal_sets_are_told_by_the_sets_themselves(spark, monkeypatch):
    """Documents of one set in another order are linked; ones whose sums only seem equal are not."""
    from prosewright.llm import neardup

    loop = "a b c d e f g h i j".split()
    same = [" ".join(loop + loop), " ".join(loop[3:] + loop + loop[:3] + loop[3:8])]  # the shingles of a ring
    assert (shingle_sets([same[0].encode()])[0] == shingle_sets([same[1].encode()])[0]).all()
    docs = [(1, same[0]), (2, same[1]), (3, same[0].upper() + " \n"), (4, "one two three four five six"), (5, "seven eight nine ten eleven twelve"), (6, "one  two three four five six")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 4}
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(frame).collect()} == want
    pairs = spark.createDataFrame([(1, 2, 3), (4, 5, 2), (1, 4, 3)], "a long, b long, near long")
    assert [tuple(r) for r in confirm(pairs, frame, 100).collect()] == [(1, 2)]
    assert neardup.words_digest(b"A  b\t") == neardup.words_digest(b"a b") != neardup.words_digest(b"b a")


def test_rows_of_equal_hashes_are_cut_each_by_their_own_marks(spark, monkeypatch):
    """Documents whose hashes of doc_id and text collide are still told apart by doc_id."""
    from prosewright.llm import repeats

    real = repeats.F.xxhash64
    monkeypatch.setattr(repeats.F, "xxhash64", lambda *c: real(repeats.F.lit(1)) if len(c) == 3 else real(*c))
    passage, other = "".join(map(chr, range(65, 91))) * 6, "".join(map(chr, range(97, 123))) * 6
    docs = spark.createDataFrame([(1, passage), (2, "0" + passage + "!"), (3, other)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.repeated_bytes(docs).collect()}
    monkeypatch.undo()
    want = {r.doc_id: r.n_removed for r in repeats.repeated_bytes(docs).collect()}
    assert got == want and want[2] == len(passage)
