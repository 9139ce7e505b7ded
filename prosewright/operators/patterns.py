"""Lists of strings found in texts: an automaton of all terms passes over each text once, whatever the length of the list.

The automaton (Aho-Corasick) is built on the driver from a list whose size is checked, broadcast, and run over Arrow batches; it tells every
occurrence with its place, overlapping ones too.  A list over ``list_bytes`` is dealt by hash to several automata, each
within the bound, and texts are passed over once for each.  Regular expressions of a rule list are compiled once a worker.

Places count code points from 0.  Null texts hold nothing; empty and null terms are left out; repeated terms are found once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIST_BYTES = 1 << 24  # of the terms of one automaton; its nodes take some 30 times as much
HITS = 50_000  # rows that are handed back at once
TERM = [T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]

_AUTOMATA: dict[str, object] = {}


def automaton(terms: list[str]):
    """All terms, each with its length."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for term in terms:
        made.add_word(term, (term, len(term)))
    made.make_automaton()
    return made


def occurrences(found, text: str, overlapping: bool = True) -> Iterator[tuple[str, int, int, str, str]]:
    """(term, start, end, character before, character after) of each hit; without ``overlapping`` those of one term keep apart, leftmost first."""
    last: dict[str, int] = {}
    for at, (term, size) in found.iter(text):
        start = at + 1 - size
        if not overlapping:
            if start < last.get(term, 0):
                continue
            last[term] = at + 1
        yield term, start, at + 1, text[start - 1 : start], text[at + 1 : at + 2]


def _rows(batches, hits_of, n_keep: int, names: list[str], kinds: list[str]):
    """Record batches of the kept columns and what ``hits_of`` tells of each text, which is the last column."""
    import pyarrow as pa

    for batch in batches:
        place, found = [], []
        out = lambda b=batch: pa.RecordBatch.from_arrays([*(c.take(pa.array(place, pa.int64())) for c in b.columns[:n_keep]), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True))], names=names)  # noqa: B023, E731
        for i, text in enumerate(batch.column(n_keep)):
            if not (value := text.as_py()):
                continue
            for hit in hits_of(value):
                place.append(i)
                found.append(hit)
                if len(found) >= HITS:
                    yield out()
                    place, found = [], []
        if found:
            yield out()


def find_terms(texts: DataFrame, terms: DataFrame, keep: list[str], text: str = "text", term: str = "term", overlapping: bool = True, list_bytes: int = LIST_BYTES) -> DataFrame:
    """``keep`` columns, term, start, end and the characters before and after (empty at the ends) of every occurrence of every term."""
    spark = texts.sparkSession
    own = terms.select(F.col(term).alias("term")).where("term != ''").distinct()
    size = own.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()["bytes"]
    shards = max(1, -(-size // list_bytes))
    schema = T.StructType([texts.schema[c] for c in keep] + TERM)
    named = texts.select(*keep, texts[text].cast("string").alias("_text"))

    def scanned(shard: int) -> DataFrame:
        mine = [r["term"] for r in own.where(F.pmod(F.xxhash64("term"), F.lit(shards)) == shard).collect()]
        if not mine:
            return spark.createDataFrame([], schema)
        shared, key = spark.sparkContext.broadcast(mine), uuid.uuid4().hex

        def found(batches):
            if key not in _AUTOMATA:  # one for each worker and list
                _AUTOMATA.clear()
                _AUTOMATA[key] = automaton(shared.value)
            made = _AUTOMATA[key]
            yield from _rows(batches, lambda t: occurrences(made, t, overlapping), len(keep), schema.names, ["string", "int32", "int32", "string", "string"])

        return named.mapInArrow(found, schema)

    return reduce(DataFrame.union, [scanned(i) for i in range(shards)])


def find_patterns(texts: DataFrame, patterns: DataFrame, keep: list[str], text: str = "text", name: str = "rule_id", pattern: str = "pattern", list_bytes: int = LIST_BYTES) -> DataFrame:
    """``keep`` columns, the pattern's name, start and end of every non-empty match of every regular expression.

    Each expression is tried on each text, so this is meant for rule lists; one over ``list_bytes`` is refused.
    """
    spark = texts.sparkSession
    own = patterns.select(F.col(name).alias("name"), F.col(pattern).alias("pattern")).where("pattern != ''")
    if own.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)).alias("bytes")).first()["bytes"] > list_bytes:
        raise ValueError(f"the list of regular expressions is over {list_bytes} bytes")
    shared = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])
    schema = T.StructType([texts.schema[c] for c in keep] + [T.StructField(name, T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def found(batches):
        compiled = [(n, re.compile(p)) for n, p in shared.value]

        def hits(value: str):
            for n, p in compiled:
                yield from ((n, m.start(), m.end()) for m in p.finditer(value) if m.end() > m.start())

        yield from _rows(batches, hits, len(keep), schema.names, ["string", "int32", "int32"])

    return texts.select(*keep, texts[text].cast("string").alias("_text")).mapInArrow(found, schema)
