"""The state kept by batches against what the whole ledger says."""

import json
import random

import pytest
from prosewright.operators import judgements, ledger
from pyspark.sql import functions as F

DAY = 86_400
NOW = 100 * DAY


def book(seed=3, n=120):
    """Ledger rows and decisions over few keys, so that most keys are spoken of many times."""
    rng = random.Random(seed)
    item = lambda: (rng.choice("abc"), rng.randint(1, 9), rng.choice(["p", "q", None]), rng.choice("xyz"))
    rows = [
        (seq, float(NOW - rng.choice([0, 1, 13, 14, 15, 40]) * DAY), rng.choice(["d1", "d2", "d3"]), rng.choice([True, True, False, None]),
         rng.choice([None, []]) or [rng.choice("abcdefgh") for _ in range(2)], [rng.choice("stuv")], [item() for _ in range(rng.randint(0, 2))], rng.choice([None, [item()]]))
        for seq in range(n)
    ]
    told = [(rng.choice(["d1", "d2", "d3"]), rng.choice(["ask", "fix", "approved"]), rng.choice("abc"), rng.choice(["p", None])) for _ in range(8)]
    return rows, told


def sets(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def expected_items(rows, told, column, kind):
    """By hand: the latest body of every (document, line, phrase) that no decision names."""
    shut = {(d, k, p or "") for d, what, k, p in told if what == kind}
    last = {}
    for seq, _, doc, ok, *rest in rows:
        for k, line, phrase, text in (rest[column] or []) if ok else ():
            key = (doc, k, phrase or "")
            last[key] = max(last.get(key, (-1,)), (seq, line, phrase or "", phrase, text))
    return sorted(((d, k, v[1], v[3], v[4], v[0]) for (d, k, p), v in last.items() if (d, k, p) not in shut), key=repr)


@pytest.mark.parametrize("fold", [None, 1, 3])
def test_state_of_batches_is_the_state_of_the_ledger(spark, tmp_path, fold):
    rows, told = book()
    root = str(tmp_path / "state")
    shuffled = rows[:]
    random.Random(5).shuffle(shuffled)  # late rows: batches do not follow the ledger's order
    cut = [shuffled[i::5] for i in range(5)]
    cut[2] += cut[0][:10]  # rows that come again in a later batch
    decisions = spark.createDataFrame(told, judgements.DECISIONS)
    for n, part in enumerate(cut):
        frame = spark.createDataFrame(part, judgements.LEDGER)
        judgements.add_batch(spark, root, n, frame, decisions if n == 1 else None)
        if n == fold:
            assert judgements.compact(spark, root, float(NOW)) == n
        if n >= 2:  # a batch that is delivered again, folded in or not
            judgements.add_batch(spark, root, n, frame)
            judgements.add_batch(spark, root, 1, spark.createDataFrame(cut[1], judgements.LEDGER), decisions)
    kept = judgements.state(spark, root)
    whole = spark.createDataFrame(rows, judgements.LEDGER)
    approved = decisions.where("kind = 'approved'")
    assert sets(judgements.judged_lines(kept, NOW)) == sets(ledger.judged(whole, approved, NOW)) != []
    assert sets(judgements.judged_forms(kept, NOW)) == sets(ledger.judged_forms(whole, NOW)) != []
    assert sets(judgements.open_items(kept, "ask")) == expected_items(rows, told, 2, "ask") != []
    assert sets(judgements.open_items(kept, "fix")) == expected_items(rows, told, 3, "fix") != []


def test_folding_forgets_what_is_stale_and_nothing_else(spark, tmp_path):
    root = str(tmp_path / "state")
    rows = [(1, float(NOW - 20 * DAY), "d", True, ["old"], ["f"], [("k", 1, "p", "t")], None), (2, float(NOW), "d", True, ["new"], [], None, None)]
    judgements.add_batch(spark, root, 7, spark.createDataFrame(rows, judgements.LEDGER))
    assert judgements.compact(spark, root, float(NOW)) == 7 == judgements.compact(spark, root, float(NOW))
    assert sets(judgements.state(spark, root).select("kind", "key")) == [("ask", "k"), ("line", "new")]
    # before folding, an earlier present would still have seen the old line; a decision closes the question for ever
    judgements.add_batch(spark, root, 8, spark.createDataFrame([], judgements.LEDGER), spark.createDataFrame([("d", "ask", "k", "p")], judgements.DECISIONS))
    assert sets(judgements.open_items(judgements.state(spark, root), "ask")) == []
    assert sets(judgements.touched(spark, root, 8)) == [("d",)]
    judgements.add_batch(spark, root, 9, spark.createDataFrame([(3, float(NOW), "d", True, None, None, [("k", 2, "p", "u")], None)], judgements.LEDGER))
    assert sets(judgements.open_items(judgements.state(spark, root), "ask")) == []


def test_nothing_nulls_and_other_columns(spark, tmp_path):
    root = str(tmp_path / "state")
    assert judgements.state(spark, root).count() == 0 == judgements.touched(spark, root, 0).count()
    assert judgements.compact(spark, root, 0.0) == -1
    rows = [(1, 5.0, None, True, ["a"], None, None, None), (2, 5.0, "d", True, [None, "b"], None, [(None, 1, "p", "t")], None), (3, None, "d", True, ["c"], None, None, None)]
    frame = spark.createDataFrame(rows, judgements.LEDGER).withColumn("kind", F.lit("other")).withColumn("body", F.lit(1)).withColumn("key", F.lit(1))
    judgements.add_batch(spark, root, 0, frame)
    judgements.add_batch(spark, root, 1, frame.limit(0))
    assert sets(judgements.state(spark, root).select("doc_key", "key", "last_when", "closed")) == [("d", "b", 5.0, False), ("d", "c", None, False)]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    rows, _ = book(seed=9, n=60)
    source, root, checkpoint = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "check")
    source.mkdir()
    names = ["seq", "when", "doc_key", "ok", "seen", "seen_form", "asks", "fixes"]
    item = lambda i: dict(zip(["line_key", "line", "phrase", "text"], i, strict=True))
    for n in range(3):
        told = [{k: [item(i) for i in v] if k in ("asks", "fixes") and v is not None else v for k, v in zip(names, r, strict=True)} for r in rows[n::3]]
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, told)))
        stream = spark.readStream.schema(judgements.LEDGER).option("maxFilesPerTrigger", 1).json(str(source))
        judgements.keep_state(stream, root, checkpoint, every=2, now=F.lit(float(NOW))).awaitTermination()
    whole = spark.createDataFrame(rows, judgements.LEDGER)
    none = spark.createDataFrame([], "doc_key string, line_key string")
    assert sets(judgements.judged_lines(judgements.state(spark, root), NOW)) == sets(ledger.judged(whole, none, NOW)) != []
