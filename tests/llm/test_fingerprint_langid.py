import hashlib
import random
import unicodedata
import zlib

import numpy as np
from prosewright.llm import fingerprint as fp
from prosewright.llm import langid
from prosewright.llm.langid import MIN_SHARE, Model, has_letter, identify, in_known_language, learn, learn_from

from pyspark.sql import functions as F

from .conftest import rows


def slow_selected(text: bytes) -> list[bytes]:
    """Selected 64-byte features of one text, window by window."""
    features = [text[i : i + 64] for i in range(len(text) - 63)]
    ranks = [int(fp._RANK[fp.LEVELS - fp.LEVELS * sum(int(fp._C_LOG_C[f.count(c)]) for c in set(f)) // fp._MOST]) for f in features]
    points = [0] * len(features)
    for i in range(len(features) - fp.RUN + 1):
        points[min(range(i, i + fp.RUN), key=lambda j: (ranks[j], j))] += 1
    chosen = [f for f, p in zip(features, points, strict=True) if p >= fp.POINTS]
    return chosen or [features[min(range(len(features)), key=lambda j: (ranks[j], j))]]


def test_selection_is_that_of_single_windows():
    texts = [r[1].encode() for r in rows() if r[1] and 64 <= len(r[1].encode()) < 1500][:12] + [b"q" * 64, b"ab" * 50]
    flat = np.frombuffer(b"".join(texts), "u1")
    sizes = np.array([len(t) for t in texts], "i8")
    at, own = fp._selected(flat, np.cumsum(sizes) - sizes, sizes)
    for i, t in enumerate(texts):
        assert [bytes(flat[a : a + 64]) for a in at[own == i]] == slow_selected(t)


def test_digest_does_not_depend_on_the_batch():
    texts = [(r[1] or "").encode() for r in rows()]
    alone = [fp.as_text(fp.digests([t])[0]) for t in texts]
    assert alone == [fp.as_text(d) for d in fp.digests(texts)]


def test_likeness_bounds():
    a, b, none = fp.digests([b"some text of a few words " * 30, b"quite another story, " * 40, b""])
    assert fp.likeness(a, a) == 1 and fp.likeness(none, none) == 1 and fp.likeness(a, none) == 0
    assert 0 <= fp.likeness(a, b) < 0.2 and fp.likeness(a, b) == fp.likeness(b, a)


def test_long_texts_are_cut_inside_and_select_what_the_whole_selects(monkeypatch):
    text = " ".join(r[1] for r in rows() if r[1]).encode() + b"q" * 900
    at, _ = fp._selected(np.frombuffer(text, "u1"), np.zeros(1, "i8"), np.array([len(text)]))
    whole = fp._mixed(np.frombuffer(text, "u1"), at)
    for block in (70, 1000, 4096):
        monkeypatch.setattr(fp, "BLOCK", block)
        assert np.array_equal(fp._hashes_of_long(text), whole)
        flat = b"z" * 300  # no feature gains enough points
        at, _ = fp._selected(np.frombuffer(flat, "u1"), np.zeros(1, "i8"), np.array([300]))
        assert np.array_equal(fp._hashes_of_long(flat), fp._mixed(np.frombuffer(flat, "u1"), at))


def test_filters_are_those_of_single_features():
    """The chain of one text, feature by feature: five bits each, a new filter after 160 distinct ones."""
    for text in ((" ".join(r[1] for r in rows()[:20] if r[1]) * 3).encode(), b"a text of some three hundred bytes, " * 9, b"short one"):
        chain, seen = [], set()
        features = ([[text[i : i + 8] for i in range(len(text) - 7)]] if len(text) < 512 else []) + ([slow_selected(text)] if len(text) >= 256 else [])
        for kind in features:
            inside = 160
            for f in kind:
                if f in seen:
                    continue
                seen.add(f)
                if inside == 160:
                    chain.append(set())
                    inside = 0
                h = int(fp._mixed(np.frombuffer(f, "u1"), np.zeros(1, "i8"))[0]) if len(f) == 64 else int.from_bytes(hashlib.sha1(f).digest()[:8], "little")
                chain[-1] |= {h >> 11 * j & 2047 for j in range(5)}
                inside += 1
        assert [set(np.flatnonzero(np.unpackbits(x)).tolist()) for x in fp.digests([text])[0]] == chain


def slow_likeness(a, b):
    a, b = (([set(np.flatnonzero(np.unpackbits(f)).tolist()) for f in x]) for x in (a, b))
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    score = lambda x, y: min(1, max(0, (len(x & y) - len(x) * len(y) / 2048) / max(min(len(x), len(y)) - len(x) * len(y) / 2048, 1e-9)))
    return sum(len(x) * max(score(x, y) for y in b) for x in a) / sum(map(len, a))


def test_short_texts_are_told_apart_by_share():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ijklmnop") for _ in range(n))
    for n in (20, 70, 100, 140, 250, 300, 600):
        own, other = text(n), text(n)
        changed = own[: n // 2] + other[: n - n // 2]
        a, b, c, d = fp.digests([own.encode(), changed.encode(), other.encode(), own[: n // 2].encode()])
        assert fp.likeness(a, b) > 0.2 and fp.likeness(a, c) < 0.2 and fp.likeness(a, d) > 0.5


def test_common_ids_are_dealt_to_several_buckets(spark):
    own = [(None, f"text number {i} without an id") for i in range(300)] + [(i, f"text {i}") for i in range(40)]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    got = fp.compare_with_edits(docs).collect()
    assert sorted((r["doc_id"] is None, r["n_chars"]) for r in got) == sorted((i is None, len(t)) for i, t in own)
    follows = {r["edited_sha256"] for r in got}
    for i in range(39):
        t = f"text {i}"
        assert hashlib.sha256((t[: len(t) - len(t) // 2] + f"text {i + 1}"[: len(t) // 2]).encode()).hexdigest() in follows
    placed = docs.selectExpr("coalesce(doc_id, -9223372036854775808) key", "xxhash64(text) h").withColumn("b", fp._bucket(F.col("key"), F.col("h"), [-(2**63)] * 3 + [10]))
    ends = {r["b"]: (r["lo"], r["hi"]) for r in placed.groupBy("b").agg(F.min(F.struct("key", "h")).alias("lo"), F.max(F.struct("key", "h")).alias("hi")).collect()}
    assert set(ends) == {1, 2, 3, 4} and all(ends[b][1] < ends[b + 1][0] for b in (1, 2, 3))


def test_edits_and_order(docs, empty, odd):
    got = {r["doc_id"]: r for r in fp.compare_with_edits(docs).collect()}
    own = sorted({(r[0], r[1] or "") for r in rows()})
    for (doc, text), (_, after) in zip(own, own[1:] + own[:1], strict=True):
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        if doc != 150:  # a repeated row is its own neighbour
            assert got[doc]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
            assert got[doc]["n_chars"] == len(text)
            prints = [fp.digests([t.encode()])[0] for t in (text, changed, after)]
            assert (got[doc]["fingerprint"], got[doc]["edited_fingerprint"]) == (fp.as_text(prints[0]), fp.as_text(prints[1]))
            assert abs(got[doc]["near_edited"] - slow_likeness(prints[0], prints[1])) < 1e-9 and abs(got[doc]["near_next"] - slow_likeness(prints[0], prints[2])) < 1e-9
    assert fp.compare_with_edits(docs).count() == len(rows())
    assert fp.compare_with_edits(empty).count() == 0 and fp.compare_with_edits(odd).count() == 3


def test_languages(docs, empty, odd):
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    for doc, text, lang, *_ in rows():
        if text is None or not any(c.isalpha() for c in text):
            assert (got[doc]["lang_pred"], got[doc]["score"]) == ("und", 0)
        assert 0 <= got[doc]["score"] <= 1
    judged = [got[doc]["lang_pred"] == lang for doc, text, lang, *_ in rows() if doc < 61 and len(text) > 100]
    assert sum(judged) >= 0.95 * len(judged)
    assert identify(empty).count() == 0
    assert identify(odd).count() == 3


def test_known_language_filter(docs, odd):
    kept = {r["doc_id"] for r in in_known_language(docs, learn_from(docs)).collect()}
    assert {130, 131, 132, 133}.isdisjoint(kept) and {0, 7, 100}.issubset(kept)
    assert in_known_language(odd, learn_from(odd)).columns == odd.columns


def slow_grams(text):
    raw = b" " + text.lower().encode() + b" "
    out = bytearray()
    for c in raw:
        c = c if c >= 128 or 97 <= c <= 122 else 32
        if c != 32 or not out or out[-1] != 32:
            out.append(c)
    return [bytes(out[i : i + 4]) for i in range(len(out) - 3)]


def learning_rows():
    return [(r[0], r[1], r[2]) for r in rows() if r[2] is not None and r[1] and zlib.crc32(str(r[0]).encode()) % 5]


def slow_model():
    """Per language: the 4-grams of enough share, and the number of all."""
    counts = {}
    for _, text, lang in learning_rows():
        for g in slow_grams(text):
            counts.setdefault(lang, {}).setdefault(g, 0)
            counts[lang][g] += 1
    total = {x: sum(c.values()) for x, c in counts.items()}
    return {x: {g for g, n in c.items() if n >= total[x] * MIN_SHARE} for x, c in counts.items()}, total


def test_scores_are_those_of_exact_gram_sets(docs):
    own, total = slow_model()
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    judged = 0
    for doc, text, *_ in rows():
        assert got[doc]["held_out"] == (zlib.crc32(str(doc).encode()) % 5 == 0)
        if text is None or not any(unicodedata.category(c).startswith("L") for c in text):
            assert (got[doc]["lang_pred"], got[doc]["score"]) == ("und", 0)
            continue
        g = slow_grams(text)
        share = {x: sum(y in own[x] for y in g) / max(1, len(g)) for x in own}
        best = max(share.values())
        assert abs(got[doc]["score"] - best) < 0.02 and share[got[doc]["lang_pred"]] >= best - 0.02
        judged += 1
    assert judged > 60


def test_only_rows_that_are_not_held_out_are_learned(spark, docs):
    model = learn_from(docs)
    _, total = slow_model()
    assert model.langs == sorted(total, key=lambda x: (-total[x], x))
    changed = docs.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 'zq zqz qzqz', text) text", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 'xx', lang) lang")
    assert np.array_equal(learn_from(changed).masks, model.masks)


def test_rare_grams_are_not_kept(spark):
    common = "abcd " * 12_000  # 5 grams a word: 60,000
    model = learn(spark.createDataFrame([("a", common + "wxyz")], "lang string, text string"))
    cover, n = model.coverage(["abcd abcd", "wxyz", ""])
    assert cover[0, 0] == 1 and cover[1, 0] < 0.01 and n[2] == 0 and MIN_SHARE * 60_000 > 1


def test_letters_are_of_the_letter_categories():
    assert not any(map(has_letter, ["½ ² ① Ⅷ", "12 34", "", "__", "!?", "٣"])) and all(map(has_letter, ["½a", "日", "ﬁ", "ñ", "ʰ", "1 2 é"]))


def test_long_texts_are_cut_inside_and_give_what_the_whole_gives(monkeypatch):
    texts = ["some words of a text, " * 200, "ein wörterbuch " * 90, "x"]
    model = Model(["a", "b"], [np.concatenate([g for g, _ in langid.grams([t])]) for t in texts[:2]])
    whole = model.coverage(texts)
    monkeypatch.setattr(langid, "BLOCK", 37)
    for a, b in zip(whole, model.coverage(texts), strict=True):
        assert np.array_equal(a, b)
    assert np.array_equal(model.coverage(texts[:1])[0][0], whole[0][0])


def test_few_grams_are_no_evidence_against_a_text(spark, docs):
    model = learn_from(docs)
    own = spark.createDataFrame([(1, "A."), (2, "qqq"), (3, "qxzj kqxv wqzx " * 9), (4, "12 ½")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in in_known_language(own, model).collect()) == [1, 2]
