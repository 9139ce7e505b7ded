"""License scans by sentence rules, with built-in functions only.

Texts are brought to sentences first: comment marks at line starts go, copyright lines stand by themselves, and a sentence
ends at a blank line, at a full stop, exclamation or question mark before white space, or at a colon before a line end, so it
may be wrapped over lines.  A sentence is normalised
(A-Z lower-cased, all but a-z and digits to single spaces) and looked up by hash in the set of known licence sentences; only
hits are mapped to the identifier of the sentence.  What is no known sentence as a whole is looked up line
by line, as notices often lack a full stop.  All else is ``?``, runs of which count once.

Licence rules are sequences of identifiers: ``id?`` may be missing, ``~`` lets unknown sentences stand between.  They are
tried in order, and what a rule matches is taken from the sequence, so a text that fits a long rule does not fit a shorter one
again.  Sentences and rules are parameters; the defaults are phrases of public licences and forms made of licence names.

Null and empty text: no sentences, no licence.  Repeated rows are scanned each, empty tables give no rows.
"""

from __future__ import annotations

import json
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, normalised.
SENTENCES = {
    "arr": ["all rights reserved"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    ],
    "mit-keep": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-asis": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "mit-liable": [
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ],
    "isc-grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "0bsd-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-asis": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "isc-liable": [
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "bsd-advert": ["3 all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd-name": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "bsd-asis": [
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    ],
    "apache2-only": [
        "you may not use this file except in compliance with the license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    ],
    "apache2-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "apache2-at": ["you may obtain a copy of the license at"],
    "apache2-url": ["http www apache org licenses license 2 0", "https www apache org licenses license 2 0"],
    "apache2-unless": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ],
    "apache2-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "asf-granted": ["licensed to the apache software foundation asf under one or more contributor license agreements"],
    "asf-notice": ["see the notice file distributed with this work for additional information regarding copyright ownership"],
    "asf-licenses": ["the asf licenses this file to you under the apache license version 2 0 the license"],
    "gpl3-free": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "gpl2-free": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"
    ],
    "gpl2-only": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    ],
    "agpl3-free": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "lgpl3-free": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "lgpl21-free": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"
    ],
    "gpl-hope": [
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ],
    "gpl-see": [
        "see the gnu general public license for more details", "see the gnu lesser general public license for more details", "see the gnu affero general public license for more details",
    ],
    "gpl-copy": [
        "you should have received a copy of the gnu general public license along with this program", "you should have received a copy of the gnu lesser general public license along with this library",
        "you should have received a copy of the gnu affero general public license along with this program",
    ],
    "gpl-ifnot": ["if not see https www gnu org licenses", "if not see http www gnu org licenses", "if not write to the free software foundation inc"],
    "mpl2-by": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "mpl2-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "epl2-by": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"],
    "unlicense-free": ["this is free and unencumbered software released into the public domain"],
    "unlicense-anyone": [
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
    ],
    "zlib-asis": ["this software is provided as is without any express or implied warranty"],
    "zlib-liable": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "bsl1-by": ["distributed under the boost software license version 1 0", "boost software license version 1 0 august 17th 2003"],
    "cc0-waived": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "wtfpl": ["you just do what the fuck you want to"],
    "postgresql-grant": [
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"
    ],
    "ofl-by": ["this font software is licensed under the sil open font license version 1 1"],
}

# Names that licences go by, normalised, and their identifiers.
NAMES = {
    "MIT": ["mit license", "mit licence", "mit", "x11 license", "expat license"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache 2 license"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3", "gnu gpl v3", "gplv3", "gpl v3", "gpl 3 0", "gpl version 3"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license v2", "gnu gpl v2", "gplv2", "gpl v2", "gpl 2 0", "gpl version 2"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "lgplv3", "lgpl v3", "lgpl 3 0"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "lgplv2 1", "lgpl v2 1", "lgpl 2 1"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "agplv3", "agpl v3", "agpl 3 0"],
    "BSD": ["bsd 3 clause license", "bsd 2 clause license", "bsd license", "3 clause bsd license", "2 clause bsd license", "new bsd license", "modified bsd license", "simplified bsd license", "bsd"],
    "ISC": ["isc license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "EPL-2.0": ["eclipse public license 2 0", "epl 2 0"],
    "CC0-1.0": ["cc0 1 0", "cc0", "cc0 1 0 universal", "creative commons zero v1 0 universal"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
    "Unlicense": ["unlicense"],
    "BSL-1.0": ["boost software license version 1 0"],
    "Zlib": ["zlib license"],
    "Artistic-2.0": ["artistic license 2 0"],
    "EUPL-1.2": ["eupl 1 2", "european union public licence 1 2"],
}
FORMS = [
    "licensed under {}", "released under {}", "distributed under {}", "published under {}", "this work is licensed under {}", "this project is licensed under {}", "this software is licensed under {}",
    "this code is licensed under {}", "this software is released under {}", "this project is released under {}", "this package is licensed under {}", "this file is licensed under {}", "available under {}",
]

RULES = [
    ("MIT", ["mit-grant", "mit-keep", "mit-asis", "mit-liable?"]),
    ("MIT", ["mit-grant", "~", "mit-keep"]),
    ("MIT", ["by:MIT", "~", "mit-grant"]),
    ("ISC", ["isc-grant", "isc-asis", "isc-liable?"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant", "isc-asis", "isc-liable?"]),
    ("Apache-2.0", ["asf-granted", "asf-notice?", "asf-licenses?", "apache2-only?", "apache2-at?", "apache2-url?", "apache2-copy?", "apache2-unless?", "apache2-see?"]),
    ("Apache-2.0", ["by:Apache-2.0?", "apache2-only", "apache2-at?", "apache2-url?", "apache2-copy?", "apache2-unless?", "apache2-see?"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "~", "gpl-hope?", "gpl-see?", "gpl-copy?", "gpl-ifnot?"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "~", "gpl-hope?", "gpl-see?", "gpl-copy?", "gpl-ifnot?"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "~", "gpl-hope?", "gpl-see?", "gpl-copy?", "gpl-ifnot?"]),
    ("GPL-3.0-or-later", ["gpl3-free", "~", "gpl-hope?", "gpl-see?", "gpl-copy?", "gpl-ifnot?"]),
    ("GPL-2.0-or-later", ["gpl2-free", "~", "gpl-hope?", "gpl-see?", "gpl-copy?", "gpl-ifnot?"]),
    ("GPL-2.0-only", ["gpl2-only", "~", "gpl-hope?", "gpl-see?", "gpl-copy?", "gpl-ifnot?"]),
    ("BSD-4-Clause", ["bsd-grant", "~", "bsd-source", "~", "bsd-binary", "~", "bsd-advert"]),
    ("BSD-3-Clause", ["bsd-grant", "~", "bsd-source", "~", "bsd-binary", "~", "bsd-name", "bsd-asis?"]),
    ("BSD-2-Clause", ["bsd-grant", "~", "bsd-source", "~", "bsd-binary", "~", "bsd-asis"]),
    ("BSD", ["bsd-grant"]),
    ("MPL-2.0", ["mpl2-by", "mpl2-copy?"]),
    ("EPL-2.0", ["epl2-by"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone?"]),
    ("Zlib", ["zlib-asis", "zlib-liable", "zlib-grant"]),
    ("BSL-1.0", ["bsl1-by"]),
    ("CC0-1.0", ["cc0-waived"]),
    ("WTFPL", ["wtfpl"]),
    ("PostgreSQL", ["postgresql-grant"]),
    ("OFL-1.1", ["ofl-by"]),
    *[(name, [f"spdx:{name}"]) for name in NAMES],
    *[(name, [f"by:{name}"]) for name in NAMES],
    ("all-rights-reserved", ["arr"]),
]


def _plain(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def known_sentences(sentences: dict[str, list[str]] = SENTENCES, names: dict[str, list[str]] = NAMES, forms: list[str] = FORMS) -> dict[str, str]:
    """Normalised sentence to identifier: the sentences given, and every form with every name, with and without an article."""
    out = {form: name for name, own in sentences.items() for form in own}
    for licence, own in names.items():
        for name in own:
            for article in ("", "the ", "an ", "a "):
                out |= {form.format(article + name): f"by:{licence}" for form in forms if form.format(article + name) not in out}
            out.setdefault(f"{forms[0].format('the ' + name)} the license", f"by:{licence}")
        out[_plain(f"SPDX-License-Identifier: {licence}")] = f"spdx:{licence}"
    return out


def _pattern(ids: list[str]) -> str:
    """A rule as a pattern over the sequence of identifiers."""
    parts = []
    for i in ids:
        if i == "~":
            parts.append(r"(?:;\?;)?")
        else:
            own = f";{re.escape(i.removesuffix('?'))};".replace("\\-", "-").replace("\\:", ":")
            parts.append(f"(?:{own})?" if i.endswith("?") else own)
    return "".join(parts)


# What turns a text into sentences: (pattern, replacement) in order; \x01 ends a sentence.
_COPYRIGHT = r"\n((?:copyright (?:\(c\)|©|[0-9])|\(c\) |© ?[0-9])[^\n\x01]*)\n"
STEPS = [
    (r"\r\n?", "\n"),
    (r"spdx-license-identifier:", "spdx-license-identifier"),
    (r"\n[ \t]*(?:<!--|/[*/]+|[*#;%>|]+/?|--+|dnl |rem )[ \t]*", "\n"),
    (r"[ \t]*(?:\*+/|-->)[ \t]*\n", "\n"),
    (r"\n[ \t\f]*\n[ \t\f\n]*", "\x01\n"),
    (r"\n", "\n\n"),
    (_COPYRIGHT, "\x01$1\x01"),
    (r"((?:[a-z0-9)\"'\]][a-z)\"'\]>]|[0-9])(?:[.!?][\"')]*[ \t\f\n]|:[ \t\f]*\n))[ \t\f\n]*", "$1\x01"),
]


def sentence_ids(text: Column, known: dict[str, str]) -> Column:
    """The array of identifiers of a text's sentences."""
    table = F.from_json(F.lit(json.dumps(known)), "map<string,string>")
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    cut = F.concat(F.lit("\n"), lower, F.lit("\n"))
    for pattern, by in STEPS:
        cut = F.regexp_replace(cut, pattern, by)
    plain = lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))

    def named(s):
        return F.when(s.isin(*known), F.try_element_at(table, s))  # a set of literals is looked up by hash

    def of_sentence(both):
        whole = F.coalesce(named(both["plain"]), F.lit("?"))
        by_line = F.transform(F.split(both["raw"], "\n+"), lambda r: F.coalesce(named(plain(r)), F.lit("?")))
        return F.when((whole == "?") & both["raw"].contains("\n"), by_line).otherwise(F.array(whole))

    return F.flatten(F.transform(F.transform(F.split(cut, "\x01"), lambda r: F.struct(r.alias("raw"), plain(r).alias("plain"))), of_sentence))


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """``keep`` columns; licences (matched rules' names in rule order, ';'-joined), n_sentences known, n_left unmatched."""
    known, rules = known_sentences() if known is None else known, RULES if rules is None else rules
    ids = F.transform(sentence_ids(F.col(text), known), lambda i: F.concat(F.lit(";"), i, F.lit(";")))
    found = docs.select(*keep, F.regexp_replace(F.array_join(ids, ""), r"(;\?;)+", ";?;").alias("seq"))
    first = F.lit(";?;")
    named = found.select(*keep, "seq", (F.col("seq").isin("", ";?;")).alias("none"))
    done = F.aggregate(
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(_pattern(r)).alias("pattern")) for n, r in rules]),
        F.struct(F.col("seq").alias("seq"), F.array().cast("array<string>").alias("names")),
        lambda state, rule: F.struct(
            F.regexp_replace(state["seq"], rule["pattern"], "").alias("seq"),
            F.when(F.rlike(state["seq"], rule["pattern"]), F.array_append(state["names"], rule["name"])).otherwise(state["names"]).alias("names"),
        ),
    )
    done = F.when(F.col("none"), F.struct(F.col("seq").alias("seq"), F.array().cast("array<string>").alias("names"))).otherwise(done)
    count = lambda c: F.regexp_count(F.replace(c, first, F.lit("")), F.lit(";[^;]+;")).cast("long")
    out = named.select(*keep, "seq", done.alias("done"))
    return out.select(*keep, F.array_join(F.array_distinct("done.names"), ";").alias("licences"), count(F.col("seq")).alias("n_sentences"), count(F.col("done.seq")).alias("n_left"))


def scan_sql() -> str:
    """The same scan in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    chars = lambda s: quoted(s).replace("\x01", "' || chr(1) || '").replace("\n", "' || chr(10) || '")
    known = ", ".join(f"('{form}', '{name}')" for form, name in known_sentences().items())
    cut = f"chr(10) || translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') || chr(10)"
    for pattern, by in STEPS:
        cut = f"regexp_replace({cut}, {quoted(pattern.replace('©', chr(0xA9)))}, {chars(by.replace('$1', chr(92) + '1'))}, 'g')"
    steps, names = [], []
    for i, (licence, ids) in enumerate(RULES):
        steps.append(f"s{i + 1} AS (SELECT *, regexp_replace(seq{i}, '{_pattern(ids)}', '', 'g') AS seq{i + 1} FROM s{i})")
        names.append(f"CASE WHEN length(seq{i + 1}) < length(seq{i}) THEN '{licence}' END")
    order = list(dict.fromkeys(x for x, _ in RULES))
    joined = f"list_filter([{', '.join(names)}], lambda x: x IS NOT NULL)"
    plain = lambda c: f"trim(regexp_replace({c}, '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH known AS (SELECT * FROM (VALUES {known}) AS k(form, name)),
cut AS (SELECT doc_id, rowid AS r, string_split({cut}, chr(1)) AS parts FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
s AS (SELECT doc_id, r, unnest(parts) AS raw, generate_subscripts(parts, 1) AS nth FROM cut),
w AS (SELECT s.*, k.name FROM s LEFT JOIN known k ON {plain("raw")} = k.form),
l AS (SELECT r, nth, unnest(string_split_regex(raw, '\\n+')) AS line, generate_subscripts(string_split_regex(raw, '\\n+'), 1) AS place FROM w WHERE name IS NULL AND contains(raw, chr(10))),
i AS (
  SELECT r, nth, 0 AS place, coalesce(name, '?') AS id FROM w WHERE name IS NOT NULL OR NOT contains(raw, chr(10))
  UNION ALL SELECT r, nth, place, coalesce(k.name, '?') FROM l LEFT JOIN known k ON {plain("line")} = k.form),
q AS (SELECT r, regexp_replace(string_agg(';' || id || ';', '' ORDER BY nth, place), '(;\\?;)+', ';?;', 'g') AS seq0 FROM i GROUP BY r),
s0 AS (SELECT doc_id, seq0 FROM (SELECT DISTINCT doc_id, r FROM cut) JOIN q USING (r)),
{", ".join(steps)}
SELECT doc_id,
  array_to_string(list_filter({order!r}, lambda n: list_contains({joined}, n)), ';') AS licences,
  CAST(len(regexp_extract_all(replace(seq0, ';?;', ''), ';[^;]+;')) AS BIGINT) AS n_sentences,
  CAST(len(regexp_extract_all(replace(seq{len(RULES)}, ';?;', ''), ';[^;]+;')) AS BIGINT) AS n_left
FROM s{len(RULES)}"""
