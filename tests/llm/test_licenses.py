import math
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from backhaul.llm import licenses

SCHEMA = (
    "doc_id long, path string, text string, license string, score string, file string, up string")


def run(spark, rows, **more):
    frame = spark.createDataFrame([(i, p, t, "x", "x", "x", "x") for i, p, t in rows], SCHEMA)
    return licenses.scan(frame, **more).collect()


def cosine(text, template):
    """TF-IDF cosine, words outside the templates as one dimension."""
    split = [re.findall("[a-z0-9]+", t.lower()) for _, t in licenses.TEMPLATES]
    df = Counter(w for words in split for w in set(words))
    n = len(split)
    idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
    words = Counter(w if w in idf else "*" for w in re.findall("[a-z0-9]+", text.lower()))
    a = {w: k * idf[w] if w in idf else math.sqrt(k) * (math.log(1 + n) + 1)
         for w, k in words.items()}
    b = {w: k * idf[w] for w, k in Counter(re.findall("[a-z0-9]+", template.lower())).items()}
    return sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(
        sum(v * v for v in a.values()) * sum(v * v for v in b.values()))


@pytest.mark.parametrize("name,text", licenses.TEMPLATES)
def test_templates_find_themselves(name, text):
    best = max(licenses.TEMPLATES, key=lambda t: cosine(text, t[1]))
    assert best[0] == name and cosine(text, text) == pytest.approx(1)


def test_scores_headers_files_and_inheritance(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    header = f"{prose}\n# Licensed under the Apache License, Version 2.0. Here.\n{prose}"
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.\n" + prose),
        (2, "a/b/c/code.py", prose),
        (3, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (4, "a/b/x.py", header),
        (5, "z/x.py", prose),
        (6, "ab/x.py", "a license may be granted or not, who knows, said the old man"),
        (7, "top.py", prose),
    ]
    got = {r.doc_id: r for r in run(spark, rows)}
    assert (got[1].license, got[1].origin) == ("MIT", "file")
    assert (got[2].license, got[2].origin, got[2].license_dir) == ("GPL-3.0", "inherited", "a/b")
    assert (got[4].license, got[4].origin) == ("Apache-2.0", "header")
    line = header.split("\n")[1]
    assert got[4].score == pytest.approx(max(cosine(line, t) for n, t in licenses.TEMPLATES
                                             if n == "Apache-2.0"), abs=1e-6)
    assert [got[i].license for i in (5, 6, 7)] == [None] * 3


def test_root_licence_reaches_all_but_null_paths(spark):
    rows = [(1, "LICENSE.txt", "Licensed under CC BY-NC 4.0."), (2, "x/y/z.txt", None),
            (3, None, ""), (None, "n.txt", "hello"), (5, "x/long.txt", "word " * 200_000),
            (6, None, "Released under the MIT License."), (6, None, "Released under the MIT License.")]
    got = {(r.doc_id, r.path): (r.license, r.origin) for r in run(spark, rows)}
    assert len(run(spark, rows)) == 7
    assert got[2, "x/y/z.txt"] == got[None, "n.txt"] == got[5, "x/long.txt"] == (
        "CC-BY-NC-4.0", "inherited")
    assert got[3, None] == (None, None) and got[6, None] == ("MIT", "file")


def test_ties_go_to_the_first_name(spark):
    two = [("B", "licensed under the same words"), ("A", "licensed under the same words")]
    got = run(spark, [(1, "x", "Licensed under the same words")], templates=two)
    assert got[0].license == "A"


def test_empty(spark):
    assert run(spark, []) == []


def test_no_python_in_the_plan(spark, capsys):
    frame = spark.createDataFrame([(1, "a", "Released under the MIT License.", *"xxxx")], SCHEMA)
    licenses.scan(frame).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def wrapped(text, mark, width):
    import textwrap
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


GPL3 = ("This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
        "more details.")
MIT = ("MIT License\n\nCopyright (c) 2019 Jane Doe\n\nPermission is hereby granted, free of charge, to any "
       "person obtaining a copy\nof this software and associated documentation files (the \"Software\"), "
       "to deal\nin the Software without restriction, including without limitation the rights\nto use, "
       "copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to "
       "permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
       "\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or "
       "substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
       "ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY")
BSD = ("Copyright 2011 The Foo Authors. All rights reserved.\n\nRedistribution and use in source and binary "
       "forms, with or without\nmodification, are permitted provided that the following conditions\nare "
       "met:\n\n   * Redistributions of source code must retain the above copyright\nnotice, this list of "
       "conditions and the following disclaimer.\n   * Redistributions in binary form must reproduce the "
       "above\ncopyright notice, this list of conditions and the following disclaimer\nin the "
       "documentation and/or other materials provided with the\ndistribution.\n")
BSD3 = ("   * Neither the name of Foo Inc. nor the names of its\ncontributors may be used to endorse or "
        "promote products derived from\nthis software without specific prior written permission.\n")
AS_IS = ("\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS\n\"AS IS\" AND ANY EXPRESS OR "
         "IMPLIED WARRANTIES, INCLUDING, BUT NOT\nLIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
         "AND FITNESS FOR\nA PARTICULAR PURPOSE ARE DISCLAIMED.")
GPL_FILE = ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n"
            " Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted "
            "to copy and distribute verbatim copies\n of this license document, but changing it is not "
            "allowed.\n\n                            Preamble\n\n" + "free software words follow here " * 400)


def test_ordinary_headers_files_and_spdx_lines(spark):
    code = "\n" + "\n".join(f"int value{i} = call{i}(argument{i});" for i in range(200))
    wanted = {
        "// SPDX-License-Identifier: MIT" + code: ("MIT", "header"),
        "# SPDX-License-Identifier: Apache-2.0" + code: ("Apache-2.0", "header"),
        "/* SPDX-License-Identifier: GPL-2.0-or-later */" + code: ("GPL-2.0", "header"),
        wrapped(GPL3, " * ", 72) + code: ("GPL-3.0", "header"),
        wrapped(GPL3.replace("version 3", "version 2"), "# ", 60) + code: ("GPL-2.0", "header"),
        wrapped(GPL3.replace("GNU", "GNU Affero"), "// ", 72) + code: ("AGPL-3.0", "header"),
        wrapped(MIT, "// ", 66) + code: ("MIT", "header"),
        MIT: ("MIT", "file"),
        BSD + AS_IS: ("BSD-2-Clause", "file"),
        BSD + BSD3 + AS_IS: ("BSD-3-Clause", "file"),
        GPL_FILE: ("GPL-3.0", "file"),
        "This project is released under the MIT License, see LICENSE for details" + code:
            ("MIT", "header"),
        "the manual is licensed under the Foo License, or so the old man said" + code: (None, None),
        "Copyright 2020 Jane Doe. All rights reserved." + code: (None, None),
        "GNU General Public License, said she, is a long name" + code: (None, None),
    }
    rows = [(i, f"d{i}/LICENSE" if t == MIT else f"d{i}/x.txt", t) for i, t in enumerate(wanted)]
    found = run(spark, rows)
    got = {r.doc_id: (r.license, r.origin) for r in found}
    assert [got[i] for i in range(len(rows))] == list(wanted.values())
    # the second step decides most of these; its SQL says the same, to the score
    texts = pd.DataFrame(rows, columns=["doc_id", "path", "text"])
    db = duckdb.connect()
    db.register("texts", texts)
    sql = db.execute(licenses.duckdb_sql("texts", "path")).fetchall()
    columns = [c[0] for c in db.description]
    assert sorted(tuple(r[c] for c in columns) for r in found) == sorted(sql)
    first_step = [r for r in run(spark, rows, templates=licenses.TEMPLATES) if r.license]
    assert len(first_step) < len([r for r in found if r.license])
