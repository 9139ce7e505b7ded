import random

import pytest
from prosewright.functions.spans import similarity
from prosewright.operators import ledger
from prosewright.operators.similarity import candidates, similar_pairs


def lines(seed, n=40):
    rng = random.Random(seed)
    words = ["값이", "크게", "올랐다", "내렸다", "the", "line", "of", "text", "x", "보고서", "기한은", "9월"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(n)]
    return out + ["".join(c for c in t if rng.random() > 0.15) for t in out[: n // 2]]


@pytest.mark.parametrize(("seed", "least"), [(1, 0.5), (2, 0.3), (3, 0.8), (4, 1.0)])
def test_pairs_equal_those_of_all_pairs(spark, seed, least):
    old, new = lines(seed), lines(seed + 10) + lines(seed)[5:15] + ["", "aaaa", "aaaaa"]
    left = spark.createDataFrame([(d, t) for d in (1, 2) for t in old] + [(1, None)], "doc_key int, a string")
    right = spark.createDataFrame([(d, t) for d in (2, 3) for t in new], "doc_key int, b string")
    got = sorted(tuple(r) for r in similar_pairs(left, right, least).collect())
    want = sorted({(2, a, b, similarity(a, b, least)) for a in old for b in new if a and b and similarity(a, b, least) >= least})
    assert got == want and want


def test_few_pairs_are_compared(spark):
    rng = random.Random(5)
    alphabet = [chr(0xAC00 + i) for i in range(400)]
    old = ["".join(rng.choice(alphabet) for _ in range(30)) for _ in range(150)]
    new = [t[:12] + rng.choice(alphabet) + t[13:] for t in old]
    left, right = spark.createDataFrame([(1, t) for t in old], "doc_key int, a string"), spark.createDataFrame([(1, t) for t in new], "doc_key int, b string")
    n = candidates(left, right, 0.8).count()
    assert 150 <= n <= 0.1 * 150 * 150
    assert sorted(r["a"] for r in similar_pairs(left, right, 0.8).collect()) == sorted(old)
    with pytest.raises(ValueError):
        similar_pairs(left, right, 0)


def test_a_split_line_hands_its_round_on_to_its_parts_only(spark):
    versions = spark.createDataFrame([("d", "앞부분은 길게 이어지고 뒷부분은 다른 말로 끝난다", 2, "뿌리")], "doc_key string, text string, round int, root string")
    targets = ["앞부분은 길게 이어지고", "뒷부분은 다른 말로 끝난다", "앞부분은 길게 이어진다"]
    frame = spark.createDataFrame([("d", t) for t in targets], "doc_key string, text string")
    now = lambda *more: spark.createDataFrame([("d", t) for t in [*targets, *more]], "doc_key string, line string")
    got = {r["text"]: r["root"] for r in ledger.lineage(frame, versions, standing=now()).collect()}
    assert got == {targets[0]: "뿌리", targets[1]: "뿌리", targets[2]: targets[2]}
    still = ledger.lineage(frame, versions, standing=now("앞부분은 길게 이어지고 뒷부분은 다른 말로 끝난다")).collect()
    assert {r["root"] == r["text"] and r["round"] == 1 for r in still} == {True}
