import hashlib
import re
import zlib

import corpus_pipeline as cp
import numpy as np
from prosewright.llm.langid import in_known_language, learn_from
from prosewright.llm.mixing import mixed_documents
from prosewright.llm.tokens import load_tokenizer

from .conftest import rows
from .test_neardup_repeats import expected_components, removed


def test_stages_take_effect(spark, tmp_path):
    own = [r for r in {r[0]: r for r in rows()}.values()]
    spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts = {r[0]: r[1] for r in own}
    assert {130, 131, 132, 133}.isdisjoint(kept["language_id"]) and 134 in kept["language_id"] and len(kept["language_id"]) >= len(own) - 9
    _, comp = expected_components(kept["language_id"].items(), 80)
    assert kept["near_dedup"] == {d: texts[d] for d in comp if comp[d] == d}
    for doc, (raw, mark) in removed(kept["near_dedup"].items()).items():
        assert kept["passage_dedup"][doc] == bytes(b for b, m in zip(raw, mark, strict=True) if not m).decode("utf-8", "ignore")
    check_mixing([r.asDict() for r in spark.read.parquet(f"{tmp_path}/passage_dedup").collect()], [r.asDict() for r in docs.collect()])
    pieces = {}
    for p in cp.run(spark, str(tmp_path)).collect():
        pieces.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
    tok, want = load_tokenizer(cp.TOKENIZER), {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0])
    assert set(pieces) == set(want)
    for doc, copies in want.items():  # copies of a document are equal
        ids = copies[0]
        assert sum(n for _, n, *_ in pieces[doc]) == len(copies) * len(ids)
        for start, n, crc, total in pieces[doc]:
            assert total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())


def check_mixing(before, after):
    """How often each document is taken, by a walk over each source's line of words."""
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in before}
    sources = sorted({r["source"] for r in before}, key=lambda s: (s is None, s or ""))
    own = {s: [r for r in before if r["source"] == s] for s in sources}
    total = {s: sum(size[r["doc_id"]] for r in own[s]) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_ones, left = {}, set(sources), float(sum(total.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_ones) for s in open_ones}
        over = {s for s in open_ones if share[s] >= 3 * total[s]}
        target |= share | {s: 3.0 * total[s] for s in over}
        if not over:
            break
        left -= sum(3 * total[s] for s in over)
        open_ones -= over
        if not open_ones:
            break
    want = {}
    for s in sources:
        words, at = int(target[s] + 0.5), 0
        line = sorted(own[s], key=lambda r: hashlib.md5(f"{r['doc_id']}|{r['text'] or ''}".encode()).hexdigest())
        for r in line:
            n = size[r["doc_id"]]
            want[r["doc_id"]] = 1 if n == 0 else sum(at + k * total[s] + n / 2 <= words for k in range(3))
            at += n
    got = {}
    for r in after:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {d: n for d, n in want.items() if n}


def test_equal_but_for_the_place_of_a_null(spark):
    own = [(1, "some words", "en", None, 2), (1, "some words", None, "en", 2), (2, "more words here", "en", "a", 3)]
    out = mixed_documents(spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    taken = {}
    for r in out:
        taken[tuple(r)] = taken.get(tuple(r), 0) + 1
    assert set(taken) <= set(own)


def test_empty_and_odd_tables(spark, tmp_path, empty, odd):
    for table in (empty, odd):
        docs = table
        for i, (_, stage) in enumerate(cp.STAGES):
            path = f"{tmp_path}/{len(table.columns)}-{i}"
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
    assert in_known_language(empty, learn_from(empty)).count() == 0
