"""Standard licence texts as they are wrapped in files."""

import textwrap

from gridframe.llm import licenses

APACHE = ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "    http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.']
MIT = ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."]
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
GPL = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
TEXTS = {
    "Apache-2.0": (APACHE, 4),
    "MIT": (MIT, 2),
    "BSD-3-Clause": (BSD, 4),
    "BSD-2-Clause": (BSD[:3], 3),
    "GPL-3.0-or-later": ([GPL.format(":", ",", 3)], 1),
    "GPL-2.0-or-later": ([GPL.format(";", ";", 2)], 1),
    "MPL-2.0": (["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."], 2),
    "ISC": (["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."], 1),
}


#: Beginnings of the texts as they are published.
FULL = {
    "MIT": """MIT License

Copyright (c) 2020 Somebody

""" + "\n\n".join(MIT) + """

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "BSD-3-Clause": """BSD 3-Clause License

Copyright (c) 2020, Somebody

""" + "\n\n".join(BSD[:3]) + """

3. Neither the name of Some Body Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "GPL-3.0": """GNU GENERAL PUBLIC LICENSE
Version 3, 29 June 2007

Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>

Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.

Preamble

The GNU General Public License is a free, copyleft license for software and other kinds of works.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}


def test_full_texts(spark):
    """Wrapped or not, the whole text is one match, and a repeated row gives it again."""
    rows = []
    for name, text in FULL.items():
        for width in (60, 78, 10_000):
            wrapped = "\n\n".join(p if p.startswith("GNU") else textwrap.fill(p, width) for p in text.split("\n\n"))
            rows += [(name, wrapped), (name, wrapped)]
    got = sorted(map(tuple, licenses.scan(spark.createDataFrame(rows, "name string, text string"), id_col="name").select("id", "license").collect()))
    assert got == sorted((name, name) for name, _ in rows)


def test_wrapped(spark):
    rows, want = [], {}
    for name, (paragraphs, n) in TEXTS.items():
        for width in (30, 72, 10_000):
            for prefix in ("", "# ", " * "):
                lines = "\n\n".join(textwrap.fill(p, width) for p in paragraphs).split("\n")
                want[len(rows)] = [(name, n)]
                rows.append((len(rows), "\n".join(["Copyright 2020 me.", *[(prefix + x).rstrip() for x in lines], "", "code"])))
    for text, found in {
        "This is not\nreleased under the MIT License at all.": [],
        "Released under\n\nthe MIT License": [],
        "Released under. The MIT License": [],
        "Intro line\nReleased under the MIT License\nno full stop": [("MIT", 1)],
        "one\n\nSPDX-License-Identifier: MIT": [("MIT", 1)],
    }.items():
        want[len(rows)] = found
        rows.append((len(rows), text))
    got = {i: [] for i in want}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("id", "first_word").collect():
        got[r["id"]].append((r["license"], r["n_sentences"]))
    assert got == want


LGPL = """{title}

Copyright (C) 1991 Free Software Foundation, Inc.

Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.

[This is the first released version of the {kind} GPL. {more}]

Preamble

The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software.
"""
#: Parts of texts as they are published, that also hold sentences of other licences, and what they are.
OTHERS = {
    "LGPL-2.0": LGPL.format(title="GNU LIBRARY GENERAL PUBLIC LICENSE", kind="library", more="It is numbered 2 because it goes with version 2 of the ordinary GPL."),
    "LGPL-2.1": LGPL.format(title="GNU LESSER GENERAL PUBLIC LICENSE", kind="Lesser", more="It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1."),
    "GPL-1.0": """GNU GENERAL PUBLIC LICENSE

Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.

Preamble

The license agreements of most software companies try to keep users at the mercy of those companies. By contrast, our General Public License is intended to guarantee your freedom to share and change free software.""",
    "GPL-2.0": """How to Apply These Terms to Your New Programs

To do so, attach the following notices to the program. It is safest to attach them to the start of each source file to most effectively convey the exclusion of warranty; and each file should have at least the "copyright" line and a pointer to where the full notice is found.

<one line to give the program's name and a brief idea of what it does.>

""" + GPL.format(";", ";", 2),
    "CC0-1.0": """CC0 1.0 Universal

The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database (each, a "Work").

Certain owners wish to permanently relinquish those rights to a Work for the purpose of contributing to a commons of creative, cultural and scientific works ("Commons") that the public can reliably and without fear of later claims of infringement build upon.""",
    "PSF-2.0": """PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2

1. This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization ("Licensee") accessing and otherwise using this software ("Python") in source or binary form and its associated documentation.

3. In the event Licensee prepares a derivative work that is based on or incorporates Python or any part thereof, and wants to make the derivative work available to others as provided herein, then Licensee hereby agrees to include in any such work a brief summary of the changes made to Python.

4. PSF is making Python available to Licensee on an "AS IS" basis.""",
    "Apache-2.0 OR BSD-2-Clause": "This software is made available under the terms of *either* of the licenses found in LICENSE.APACHE or LICENSE.BSD. Contributions to this software is made under the terms of *both* these licenses.",
}


def wrapped_rows(texts):
    return [(name, "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))) for name, text in texts.items() for width in (50, 78, 10_000)]


def test_texts_that_hold_others(spark):
    """A whole text is its own licence alone, though it quotes sentences of others."""
    rows = wrapped_rows(OTHERS)
    got = sorted(map(tuple, licenses.scan(spark.createDataFrame(rows, "name string, text string"), id_col="name").select("id", "license").collect()))
    assert got == sorted((name, name) for name, _ in rows)


def test_texts_that_hold_others_in_sql(spark, tmp_path):
    """The rules' other reading, in SQL, gives the same rows on whole texts, apart and one after the other."""
    import duckdb

    texts = [text for _, text in wrapped_rows(OTHERS | FULL)]
    rows = [*enumerate(texts), (len(texts), "\n\n".join(texts[::3])), (len(texts) + 1, None), (len(texts) + 2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan(docs).select("id", "license", "rule", "first_word", "n_sentences").collect()))
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, license, rule, first_word, n_sentences FROM ({licenses.ORACLE})").fetchall()
    assert got == sorted(map(tuple, want)) and len(got) > len(texts)
