"""License scans and WARC packages."""

from __future__ import annotations

import base64
import hashlib
import io
import zipfile

import pytest
from sheafline.llm import licenses, warc

MIT = """/*
 * Copyright (c) 2020 Someone
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights.
 *
 * The above copyright notice and this permission notice shall be included in all
 * copies or substantial portions of the Software.
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
 * IMPLIED, INCLUDING OTHERS.
 */"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""


def scan(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, licenses long, sequence string")
    return {r.doc_id: r for r in licenses.scan(docs).collect()}


def test_licences(spark):
    texts = {
        1: MIT, 2: APACHE, 3: "Text here\nReleased under the MIT License.\nMore text. Licensed under the Apache License, Version 2.0.", 4: "Nothing of the kind.",
        5: None, 6: "", 7: "All rights reserved.", 8: "x " * 20000 + "\nLicensed under CC BY-NC 4.0.", 9: "// SPDX-License-Identifier: Apache-2.0\nint a;", 10: "We discuss the MIT License in general terms.",
        11: "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.",
    }
    got = scan(spark, texts.items())
    named = {i: r.licenses for i, r in got.items()}
    assert named == {1: "MIT", 2: "Apache-2.0", 3: "Apache-2.0 MIT", 4: "", 5: "", 6: "", 7: "", 8: "CC-BY-NC-4.0", 9: "Apache-2.0", 10: "", 11: "MIT GPL-3.0"}
    assert got[1].sentence_ids == "copyright mit:grant mit:notice mit:asis" and got[1].unmatched_ids == "copyright"
    assert got[2].sentence_ids == "apache-2:ref apache-2:use apache-2:copy apache-2:asis apache-2:see"
    assert got[7].unmatched_ids == "rights" and got[5].n_sentences_known == 0
    assert scan(spark, []) == {}


def test_sql_agrees(spark):
    import duckdb

    rows = [(1, MIT), (2, APACHE), (3, None), (4, "a. b\n\nLicensed under CC BY 4.0\nx"), (5, MIT + "\n" + APACHE), (6, "All rights reserved! Released under the MIT License")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.execute(licenses.oracle()).fetchall()
    assert sorted(tuple(r) for r in scan(spark, rows).values()) == sorted(want)


GNU = """This {what} is free software: you can redistribute it and/or modify
it under the terms of the GNU {name}General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
{name}General Public License for more details.

You should have received a copy of the GNU {name}General Public License
along with this {what}. If not, see <https://www.gnu.org/licenses/>.
"""
#: Notices as they stand in files, written by hand, and the licences that they give.
NOTICES = {
    "// " + GNU.format(what="program", name="").replace("\n", "\n// "): "GPL-any",
    "/* " + GNU.format(what="library", name="Lesser ").replace("\n", "\n * ") + "*/": "LGPL-any",
    GNU.format(what="program", name="Affero ").replace("\n", "\r\n"): "AGPL-any",
    "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense.": "LGPL-any",
    "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:": "Zlib",
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy. For more information, please refer to <https://unlicense.org>": "Unlicense",
    "Copyright (c) 2020, A. Author\n\nThis Font Software is licensed under the SIL Open Font License, Version 1.1.\nThis license is copied below, and is also available with a FAQ at:\nhttp://scripts.sil.org/OFL": "OFL-1.1",
    "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0": "EPL-2.0",
    "All rights reserved. This program and the accompanying materials\nare made available under the terms of the Eclipse Public License v1.0\nwhich accompanies this distribution.": "EPL-1.0",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.": "MPL-2.0",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.": "ISC",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2) Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials.\n\nTHIS SOFTWARE IS PROVIDED BY THE AUTHORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.": "BSD-2-Clause",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND-4.0",
    "This text is released under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License!": "CC-BY-NC-SA-4.0",
    "Licensed under CC BY-NC-ND 4.0": "CC-BY-NC-ND-4.0", "Released under CC0 1.0 Universal": "CC0-1.0", "Dedicated to the public domain.": "CC0-1.0", "Released under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1", "Distributed under the terms of the GNU Affero General Public License, v. 3.": "AGPL-3.0",
    "# SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1", "# SPDX-License-Identifier: AGPL-3.0-only\n": "AGPL-3.0", "-- SPDX-License-Identifier: CC-BY-NC-SA-4.0": "CC-BY-NC-SA-4.0",
    "// SPDX-License-Identifier: OFL-1.1": "OFL-1.1", "// SPDX-License-Identifier: Unlicense\nx": "Unlicense", "// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "// SPDX-License-Identifier: mitx": "",
    "The MIT License is short. We like CC BY 4.0 and the Eclipse Public License.": "", "Licensed under the Imaginary License, version 2.0.": "", "Permission is granted to nobody.": "",
}


def test_notices(spark):
    """Each notice alone, and repeated rows of one text, each of them scanned; SQL agrees on all."""
    import duckdb

    rows = [*enumerate(NOTICES), (0, next(iter(NOTICES))), (None, "Released under CC BY 4.0.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in licenses.scan(docs).collect()]
    assert sorted((r[0], r[2]) for r in got if r[0] is not None) == sorted([*enumerate(NOTICES.values()), (0, "GPL-any")])
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(got, key=repr) == sorted(con.execute(licenses.oracle()).fetchall(), key=repr)


def test_each_known_form(spark):
    """Every form is found in a text of its own, so all have an anchor; every rule's identifiers are known, every identifier but two has a rule."""
    leads = {"under": "licensed under the", "spdx": "SPDX-License-Identifier:"}
    texts = [" ".join([leads.get(form.split()[0], form.split()[0]), *form.split()[1:]]) for form in licenses.KNOWN]
    got = scan(spark, enumerate(texts))
    assert [got[i].sentence_ids for i in range(len(texts))] == list(licenses.KNOWN.values())
    ids = {*licenses.KNOWN.values(), *(n for n, _ in licenses.PATTERNS)}
    assert ids - {i for _, rule in licenses.RULES for i in rule} == {"rights", "copyright"} and all(set(rule) <= ids for _, rule in licenses.RULES)


@pytest.mark.parametrize("wide", [False, True])
def test_zip(wide):
    out = io.BytesIO()
    package = warc.ZipWriter(out, wide)
    package.add("archive/a", b"x" * 1000)
    package.add("indexes/é", b"")
    package.close()
    data = out.getvalue()
    read = zipfile.ZipFile(io.BytesIO(data))
    assert read.testzip() is None and read.read("archive/a") == b"x" * 1000 and read.namelist() == ["archive/a", "indexes/é"]
    held = warc.members(io.BytesIO(data), len(data))
    assert {k: data[a : a + n] for k, (a, n) in held.items()} == {"archive/a": b"x" * 1000, "indexes/é": b""}


def test_reads_other_zips():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open("big", "w", force_zip64=True) as m:
            m.write(b"abc" * 50)
        z.writestr("b", b"qq")
        z.comment = b"PK\x05\x06 a note that looks like an end"
    data = out.getvalue()
    held = warc.members(io.BytesIO(data), len(data))
    assert {k: data[a : a + n] for k, (a, n) in held.items()} == {"big": b"abc" * 50, "b": b"qq"}
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("b", b"q" * 100)
    with pytest.raises(ValueError):
        warc.members(packed, len(packed.getvalue()))
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"none"), 4)


def test_pages(spark):
    rows = [(5, "<p>é</p>"), (3, "<p>é</p>"), (9, None), (8, ""), (1, "one"), (1, "one"), (2, "one"), (None, "one"), (None, "alone"), (11, "z" * 100_000)]
    pages = spark.createDataFrame([(i, t, "u", "d") for i, t in rows], "page_id long, html string, url string, digest string")

    def want(smallest):
        out = []
        for i, t in rows:
            data = (t or "").encode()
            ids = [j for j, u in rows if (u or "").encode() == data and j is not None]
            first = min(ids, default=None)
            revisit = len(data) >= smallest and first is not None and i != first
            out.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
        return sorted(out, key=str)

    for smallest, most, lines in ((0, 64_000_000, 2000), (5, 300, 1)):
        got = warc.archive_pages(pages, smallest, most, lines).collect()
        assert sorted([(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == want(smallest)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_damage_is_found():
    member = warc.record("urn:page:1", "urn:record:1", b"payload")
    fields, http, body = warc.parse(member)
    assert body == b"payload" and fields["WARC-Type"] == "response" and http["Content-Length"] == "7"
    fields, http, body = warc.parse(warc.record("urn:page:2", "urn:record:2", b"payload", "urn:record:1"))
    assert body == b"" and http["Content-Length"] == "7" and fields["WARC-Refers-To"] == "<urn:record:1>"
