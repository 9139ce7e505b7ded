import math

import duckdb
import numpy as np
from prosewright.llm import queries as q
from prosewright.llm.ann import encode, search, train
from prosewright.llm.license import RULES, SENTENCES, known_sentences, scan_licenses
from prosewright.llm.mixing import SCHEDULES, mix, mixed_documents, segments
from prosewright.llm.urlfilter import judge_urls, rules_table
from pyspark.sql import functions as F

from .conftest import rows


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toPandas())
    return sorted(map(repr, con.execute(sql).fetchall()))


def spark_rows(df, sql):
    con_names = [c.split()[-1].rstrip(",") for c in sql]
    return sorted(repr(tuple(r[c] for c in con_names)) for r in df.collect())


def test_mix_matches_sql_and_targets(docs):
    got = mix(docs)
    assert spark_rows(got, ["doc_id", "size", "source_size", "target", "taken", "position"]) == oracle(q.oracle_sql()["op3_curriculum_mixing"], documents=docs)
    by = {}
    for r, source in [(r, r["source_size"]) for r in got.collect()]:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((source, r["target"]), []).append(r["taken"])
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 0.5
    assert math.isclose(sum(t for _, t in by), sum(r["size"] for r in got.collect()), rel_tol=1e-9)


def test_schedules_invert():
    for schedule in SCHEDULES:
        parts = segments(schedule)
        assert math.isclose(parts[-1][4], 1) and parts[0][3] == 0


def test_mixed_documents_keep_columns_and_order(docs, empty, odd):
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    taken = {}
    for r in mix(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    copies = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    size = {r[0]: len((r[1] or "").split()) for r in rows()}
    assert all(abs(copies.get(d, 0) * size[d] - taken[d]) <= max(1, size[d]) for d in size if d != 150 and size[d])
    assert mixed_documents(empty).count() == 0 and mixed_documents(odd).columns == odd.columns
    assert mix(empty).count() == 0 and mix(odd).count() == 3


PAGES = [
    "http://a.example.com/en/7?x=1", "https://EXAMPLE.com/en/8#t", "http://example.net/de/81", "http://x.example.net/de/9", "ftp://notexample.net/de/8", "http://o.org/es/", "http://o.org/es",
    "no scheme", None, "", "://", "http://com/en/", "http://a.b.c.com", "http://com.evil/en/1", "x://y.net/de/://z.com/en/", "http://É.COM/en/É",
]


def test_urls_match_sql(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(PAGES)], "page_id long, url string, host string, rule string")
    got = judge_urls(pages, rules_table(spark, q.URL_RULES))
    assert spark_rows(got, ["page_id", "host", "path", "rule", "verdict"]) == oracle(q.URL_SQL, pages=pages)
    assert judge_urls(pages.limit(0), rules_table(spark, q.URL_RULES)).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, rules_table(spark, q.URL_RULES).limit(0)).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    rules = [("block", f"h{i}.com", f"/p{i % 10}/") for i in range(300)]
    pages = spark.createDataFrame([(i, f"http://www.h{i}.com/p{i % 10}/x") for i in range(400)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in judge_urls(pages, rules_table(spark, rules)).collect()}
    assert got == {i: "block" if i < 300 else "allow" for i in range(400)}


# The published layout of licence notices, with names of holders made up.
MIT_TEXT = """MIT License

Copyright (c) 2020 Some Holder
Copyright (c) 2021 Another Holder

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
APACHE_HEADER = """/*
 * Copyright 2020 Some Holder
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
int main() {}"""
GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.
import os"""
BSD_HEADER = """// Copyright (c) 2009 Some Holder. All rights reserved.
//
// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:
//
//   1. Redistributions of source code must retain the above copyright
//      notice, this list of conditions and the following disclaimer.
//   2. Redistributions in binary form must reproduce the above copyright
//      notice, this list of conditions and the following disclaimer in the
//      documentation and/or other materials provided with the distribution.
//   3. Neither the name of the copyright holder nor the names of its
//      contributors may be used to endorse or promote products derived from
//      this software without specific prior written permission."""


def test_licences(spark, docs, empty, odd):
    mit = ". ".join(SENTENCES[i][0] for i in ("mit-grant", "mit-keep", "mit-asis")) + "."
    cases = [
        ("Released under the MIT License.", "MIT", 1, 0), (mit, "MIT", 3, 0), (mit + " All rights reserved!", "MIT;all-rights-reserved", 4, 0),
        ("licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.", "Apache-2.0", 2, 0),
        ("a paragraph of text\nReleased under the MIT License\nwithout a full stop", "MIT", 1, 0), ("<!-- SPDX-License-Identifier: GPL-2.0-only -->\n<p>", "GPL-2.0-only", 1, 0),
        ("This work is licensed under\na CC BY-NC 4.0.", "CC-BY-NC-4.0", 1, 0), ("The MIT License was named.", "", 0, 0), ("MIT License", "", 0, 0), (None, "", 0, 0), ("", "", 0, 0),
        (MIT_TEXT, "MIT", 4, 0), (APACHE_HEADER, "Apache-2.0", None, 0), (GPL_HEADER, "GPL-3.0-or-later", None, 0), (BSD_HEADER, "BSD-3-Clause;all-rights-reserved", 5, 0),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0", 2, 0),
        ("words, words. " * 400 + "\r\n" + MIT_TEXT.replace("\n", "\r\n") + "\r\nLicensed under CC0.", "MIT;CC0-1.0", 5, 0),
    ]
    own = spark.createDataFrame([(i, t[0]) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: (r["licences"], r["n_sentences"], r["n_left"]) for r in scan_licenses(own).collect()}
    for i, (_, licences, n, left) in enumerate(cases):
        assert got[i] == (licences, got[i][1] if n is None else n, left), (i, got[i])
    for table in (own, docs):
        assert spark_rows(scan_licenses(table), ["doc_id", "licences", "n_sentences", "n_left"]) == oracle(q.oracle_sql()["op7_license_sentences"], documents=table.select("doc_id", "text"))
    assert scan_licenses(empty).count() == 0 and scan_licenses(odd).count() == 3
    known = set(known_sentences().values())
    assert all(i == "~" or i.removesuffix("?") in known for _, ids in RULES for i in ids) and len(known_sentences()) > 500


def test_own_licence_sentences_and_rules(spark):
    own = spark.createDataFrame([(1, "Free to read. Something else. Not to be sold."), (2, "Not to be sold. Free to read."), (3, "Free to read.")], "doc_id long, text string")
    got = scan_licenses(own, known={"free to read": "r", "not to be sold": "s"}, rules=[("both", ["r", "~", "s"]), ("sold", ["s", "x?"])])
    assert {r["doc_id"]: (r["licences"], r["n_sentences"], r["n_left"]) for r in got.collect()} == {1: ("both", 2, 0), 2: ("sold", 2, 1), 3: ("", 1, 1)}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 16))
    x[500:560] = x[500]  # copies: ties go to the smaller id
    data = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    data += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2100, [1.0] * 3), (2200, [None] * 16), (100, data[100][1])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for r in search(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == set(range(0, 1200, 100))
    hits = 0
    for query, found in got.items():
        d = np.sqrt(((x - x[query]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(len(x)), d)) if i != query][:10]
        found = sorted(found, key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11))
        assert all(math.isclose(r["score"], d[r["vec_id"]], rel_tol=1e-12, abs_tol=1e-12) for r in found)
        hits += len({r["vec_id"] for r in found} & set(want))
    assert hits >= 0.95 * 10 * len(got)
    assert [r["vec_id"] for r in sorted(got[500], key=lambda r: r["rank"])] == list(range(501, 511))
    assert search(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = search(table.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 100 == 0)
    assert few.count() == 2


def test_neighbours_in_a_large_group_of_near_copies_are_the_true_ones(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[500:3500] = x[500] + 1e-5 * rng.normal(size=(3000, 32))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in search(table, F.col("vec_id") % 200 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for query in range(0, 4000, 200):
        d = np.sqrt(((x - x[query]) ** 2).sum(axis=1))
        d[query] = np.inf
        assert got[query] == np.argsort(d, kind="stable")[:10].tolist()


def test_a_repeated_id_takes_one_place(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    near = x[0] + 0.01 * rng.normal(size=(3000, 8))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, v.tolist()) for v in near] + [(1001, near[0].tolist())] * 2000
    got = [r["vec_id"] for r in search(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()]
    d = np.append(np.sqrt(((x - x[0]) ** 2).sum(axis=1))[1:], [np.sqrt(((near - x[0]) ** 2).sum(axis=1)).min(), np.sqrt(((near[0] - x[0]) ** 2).sum())])
    assert got == [int(i) for i in np.append(np.arange(1, 300), [1000, 1001])[np.argsort(d)[:10]]]


def test_super_blocks_of_queries_find_the_same(spark, monkeypatch):
    import prosewright.llm.ann as ann

    rng = np.random.default_rng(5)
    data = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 8)))]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = [sorted(map(tuple, search(table, F.col("vec_id") % 30 == 0, query_bytes=n).collect())) for n in (1 << 24, 8 * 8 * 7)]
    assert found[0] == found[1] and len(found[0]) == 300

    best = [ann.Nearest(np.array([0, 30]), np.array([data[0][1], data[30][1]]), np.zeros((1, 1, 8), "f4"), 10) for _ in range(2)]
    x = np.array([v for _, v in data])
    for b, step in zip(best, (900, 70), strict=True):  # block after block, with the bound of those before
        for lo in range(0, 900, step):
            part = x[lo : lo + step]
            b.add(np.arange(lo, lo + len(part)), np.zeros((len(part), 1), "u1"), np.zeros(len(part), "f4"), np.linalg.norm(part, axis=1), part)
    assert all(np.array_equal(a, b) for a, b in zip(best[0].rows(), best[1].rows(), strict=True))


def test_beam_search_is_no_worse_than_greedy():
    x = np.random.default_rng(2).normal(size=(300, 12))
    books = train(x, books=4, words=16)

    def error(beam):
        codes, norms = encode(x, books, beam)
        made = sum(books[m][codes[:, m]] for m in range(4))
        assert np.allclose((made**2).sum(axis=1), norms, rtol=1e-3, atol=1e-3)
        return ((x - made) ** 2).sum()

    assert error(6) <= error(1)


def test_codes_leave_few_rows_to_rerank():
    from prosewright.llm.ann import Nearest, left_over

    rng = np.random.default_rng(2)
    x = rng.normal(size=(46_384, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books, x = train(x[:16_384]), x[16_384:]  # none of the rows has trained the books
    asked = np.arange(0, len(x), 1500)
    codes, norms = (np.concatenate(c) for c in zip(*(encode(x[lo : lo + 1024], books) for lo in range(0, len(x), 1024)), strict=True))
    near = Nearest(asked, x[asked], books, 10)
    near.add(np.arange(len(x)), codes, norms, left_over(x, codes, books), x)
    assert near.reranked < 0.05 * near.scored
    for i, (ids, far) in zip(asked, near.found, strict=True):
        exact = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        exact[i] = np.inf
        assert ids.tolist() == np.argsort(exact)[:10].tolist() and np.allclose(far, np.sort(exact)[:10])
