import pytest
from prosewright.operators import planting as P
from prosewright.operators.planting import Specimen
from prosewright.plans import planted
from pyspark.sql import functions as F

TWO = [Specimen("a", "x", "bad\nx", "good\nx"), Specimen("a", "y", "bad y", "good y"), Specimen("b", "z", "bad z", "good z", "n")]
FOUND = "doc_key long, line_no int, kind string, match string, note string"


def docs(spark, *rows):
    return spark.createDataFrame(rows, "doc_key long, raw string, turn long, after int")


def test_blocks_stand_where_the_plants_say(spark):
    texts, plants = P.plant(docs(spark, (1, "one\ntwo", 0, 1), (2, "one", 1, 99), (3, None, None, None), (4, "", -1, -5)), TWO, F.col("turn"), F.col("after"))
    said = {(r["doc_key"], r["side"]): r["raw"].split("\n") for r in texts.collect()}
    assert said[1, "bad"] == ["one", "", "bad", "x", "", "", "bad z", "", "two"] and said[1, "good"] == ["one", "", "good", "x", "", "", "good z", "", "two"]
    assert said[2, "bad"][:3] == ["one", "", "bad y"] and said[3, "bad"] == ["", "bad", "x", "", "", "bad z", "", ""]
    rows = plants.collect()
    assert len(rows) == 8 and {r["doc_key"]: r["kind"] for r in rows if r["family"] == "a"} == {1: "x", 2: "y", 3: "x", 4: "y"}
    own = {(s.family, s.kind): s for s in TWO}
    for r in rows:
        for side in ("bad", "good"):
            block = said[r["doc_key"], side][r["first_line"] - 1 : r["last_line"]]
            assert "\n".join(block) == getattr(own[r["family"], r["kind"]], side)


def test_twins_have_as_many_lines():
    with pytest.raises(ValueError):
        P.families([Specimen("a", "x", "one\ntwo", "one")])


def test_nothing_is_planted_into_no_document(spark):
    texts, plants = P.plant(docs(spark).limit(0), TWO, F.col("turn"), F.col("after"))
    assert texts.count() == 0 and plants.count() == 0


def test_net_of_the_clean_twin(spark):
    plants = spark.createDataFrame([(1, "a", "x", "", 2, 3), (1, "b", "z", "n", 6, 6), (2, "a", "x", "", 2, 3), (3, "a", "x", "", 2, 3), (4, "a", "x", "", 2, 3), (5, "b", "z", "n", 6, 6)], "doc_key long, family string, kind string, note string, first_line int, last_line int")
    long = "a quotation of more than twenty characters"
    bad = spark.createDataFrame([(1, 2, "x", "bad", ""), (1, 6, "z", "q", "no"), (2, 3, "x", "same", ""), (3, 9, "x", "elsewhere", ""), (4, None, "x", long, None), (5, 6, "z", "q", "other")], FOUND)
    good = spark.createDataFrame([(2, 3, "x", "same", ""), (4, 1, "x", long + " still", None), (1, 2, "x", "other", "")], FOUND)
    got = {(r["doc_key"], r["family"]): (r["found"], r["net"]) for r in P.caught(plants, bad, good).collect()}
    assert got == {(1, "a"): (True, True), (1, "b"): (True, True), (2, "a"): (True, False), (3, "a"): (False, False), (4, "a"): (True, False), (5, "b"): (False, False)}
    rows = {r["family"]: (r["planted"], r["found"], r["net"], r["recall"], r["net_recall"]) for r in P.recall(P.caught(plants, bad, good), ["family"]).collect()}
    assert rows == {"a": (4, 3, 1, 0.75, 0.25), "b": (2, 1, 1, 0.5, 0.5)}


def test_specimens_are_of_all_families():
    by = P.families(planted.SPECIMENS)
    assert {f: len(own) for f, own in by.items()} == {"words": 31, "form": 19, "piled": 22}
    assert len({s.kind for s in planted.SPECIMENS}) == 39 and len({s.note for s in by["piled"]} - {""}) == 20
    assert all(s.bad != s.good for s in planted.SPECIMENS)


def test_a_mix_of_registers_is_found_where_other_plants_leave_it_undecided(spark):
    # Defects of the words and form families that are plain sentences too: three plain ones against four polite ones.
    texts = spark.createDataFrame([(k, "") for k in (2090, 8228, 3212, 10032, 7304, 12320)] + [(22, "")], "doc_key long, raw string")
    rows = planted.hits(texts).collect()
    assert len(rows) == 21 and {r["kind"] for r in rows if r["family"] == "piled"} == {"register_mix"}
    assert [r for r in rows if not (r["found"] and r["net"])] == []
