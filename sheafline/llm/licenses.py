"""License scans by sentence rules, in DataFrame functions only.

Texts are cut into normalised sentences; each is brought to one form and looked up among the forms of known licence
sentences, which gives its identifier (patterns serve those with names or years); ordered rules then match the
sequence of identifiers, and what a rule has matched is not matched again.
All of it is one projection over the row: nothing is shuffled, and texts that have none of the anchor words skip it.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of which every known licence sentence has one. Single words, as lines may wrap between two.
ANCHORS = r"licen[sc]|copyright|permission|reserved|redistribut|warrant|domain|spdx|commons|cc0|cc[\s#*/\"'()<>=:;_-]+by"
#: Openers of licence sentences, which begin a sentence wherever they begin a line.
OPENERS = "licensed under|released under|this work is|this software is|this program is|this file is|this font software is|this library is|permission is hereby|permission is granted|permission to use|redistribution and use|redistributions|the above copyright|copyright|spdx-license-identifier|you may|you should have|see the|unless required|neither the name|all rights reserved"
#: Licence sentences that have one form each: (identifier, forms without commas, versions as v2.0).
SENTENCES = (
    ("apache-2:use", ("you may not use this file except in compliance with the license",)),
    ("apache-2:copy", ("you may obtain a copy of the license at", "you may obtain a copy of the license at http www.apache.org licenses license 2.0", "you may obtain a copy of the license at https www.apache.org licenses license 2.0")),
    ("apache-2:asis", ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",)),
    ("apache-2:see", ("see the license for the specific language governing permissions and limitations under the license",)),
    ("mit:notice", ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",)),
    ("bsd:grant", ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",)),
    ("bsd:source", ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",)),
    ("mpl-2:ref", ("this source code form is subject to the terms of the mozilla public license v2.0",)),
    ("mpl-2:copy", ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0 license", "if a copy of the mpl license was not distributed with this file you can obtain one at https mozilla.org mpl 2.0")),
    ("unlicense:grant", ("this is free and unencumbered software released into the public domain",)),
    ("unlicense:see", ("for more information please refer to http unlicense.org", "for more information please refer to https unlicense.org")),
    ("zlib:asis", ("this software is provided as is without any express or implied warranty",)),
    ("zlib:grant", ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",)),
    ("ofl-1.1:grant", ("permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell modified and unmodified copies of the font software subject to the following conditions",)),
    ("ofl-1.1:see", ("this license is copied below and is also available with a faq at http scripts.sil.org ofl", "this license is copied below and is also available with a faq at https scripts.sil.org ofl", "this license is copied below and is also available with a faq at https openfontlicense.org")),
    ("rights", ("all rights reserved",)),
)
#: Names by which a text refers to its licence, as in "licensed under the terms of the ...".
NAMES = (
    ("apache-2:ref", ("apache license v2.0", "apache license v2.0 the license", "apache license 2.0", "apache 2.0 license")),
    ("mit:ref", ("mit license", "expat license")),
    ("gpl-any:ref", ("gnu general public license v2 or any later version", "gnu general public license v2.0 or any later version", "gnu general public license v3 or any later version", "gnu general public license v3.0 or any later version")),
    ("gpl-3:ref", ("gnu general public license v3", "gnu general public license v3.0")),
    ("gpl-2:ref", ("gnu general public license v2", "gnu general public license v2.0")),
    ("lgpl-any:ref", ("gnu lesser general public license v2.1 or any later version", "gnu lesser general public license v3 or any later version", "gnu lesser general public license v3.0 or any later version")),
    ("lgpl-3:ref", ("gnu lesser general public license v3", "gnu lesser general public license v3.0")),
    ("lgpl-2.1:ref", ("gnu lesser general public license v2.1",)),
    ("agpl-3:ref", ("gnu affero general public license v3", "gnu affero general public license v3.0", "gnu affero general public license v3 or any later version", "gnu affero general public license v3.0 or any later version")),
    ("bsd-3:ref", ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license")),
    ("bsd-2:ref", ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license")),
    ("isc:ref", ("isc license",)),
    ("mpl-2:ref", ("mozilla public license v2.0", "mozilla public license 2.0")),
    ("epl-2:ref", ("eclipse public license v2.0", "eclipse public license 2.0")),
    ("epl-1:ref", ("eclipse public license v1.0", "eclipse public license 1.0")),
    ("zlib:ref", ("zlib license",)),
    ("bsl-1.0:ref", ("boost software license v1.0",)),
    ("ofl-1.1:ref", ("sil open font license v1.1", "open font license v1.1")),
    ("unlicense:ref", ("unlicense",)),
    ("cc-by-nc-sa-4:ref", ("cc by nc sa 4.0", "creative commons attribution noncommercial sharealike 4.0")),
    ("cc-by-nc-nd-4:ref", ("cc by nc nd 4.0", "creative commons attribution noncommercial noderivatives 4.0", "creative commons attribution noncommercial noderivs 4.0")),
    ("cc-by-nc-4:ref", ("cc by nc 4.0", "creative commons attribution noncommercial 4.0")),
    ("cc-by-sa-4:ref", ("cc by sa 4.0", "creative commons attribution sharealike 4.0")),
    ("cc-by-nd-4:ref", ("cc by nd 4.0", "creative commons attribution noderivatives 4.0", "creative commons attribution noderivs 4.0")),
    ("cc-by-4:ref", ("cc by 4.0", "creative commons attribution 4.0")),
    ("cc0:ref", ("cc0 1.0", "public domain")),
)
#: Licences by their SPDX identifiers, as (identifier, the tag as sentences write it).
TAGS = (
    ("spdx:apache-2.0", "apache 2.0"), ("spdx:mit", "mit"), ("spdx:gpl-3.0", "gpl 3.0"), ("spdx:gpl-2.0", "gpl 2.0"), ("spdx:lgpl-3.0", "lgpl 3.0"), ("spdx:lgpl-2.1", "lgpl 2.1"), ("spdx:agpl-3.0", "agpl 3.0"),
    ("spdx:bsd-3", "bsd 3 clause"), ("spdx:bsd-2", "bsd 2 clause"), ("spdx:isc", "isc"), ("spdx:mpl-2.0", "mpl 2.0"), ("spdx:epl-2.0", "epl 2.0"), ("spdx:epl-1.0", "epl 1.0"), ("spdx:zlib", "zlib"),
    ("spdx:bsl-1.0", "bsl 1.0"), ("spdx:ofl-1.1", "ofl 1.1"), ("spdx:unlicense", "unlicense"), ("spdx:cc0-1.0", "cc0 1.0"), ("spdx:cc-by-4.0", "cc by 4.0"), ("spdx:cc-by-sa-4.0", "cc by sa 4.0"), ("spdx:cc-by-nc-4.0", "cc by nc 4.0"),
    ("spdx:cc-by-nd-4.0", "cc by nd 4.0"), ("spdx:cc-by-nc-sa-4.0", "cc by nc sa 4.0"), ("spdx:cc-by-nc-nd-4.0", "cc by nc nd 4.0"),
)
#: Licence sentences that hold names or years or go on freely, as patterns; the first that matches names the sentence.
PATTERNS = (
    ("mit:grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction.*"),
    ("mit:asis", r"the software is provided as is without warranty of any kind express or implied.*"),
    ("gpl:redistribute", r"(this \w+ is free software )?you can redistribute it and or modify it under the terms of the gnu general public license.*"),
    ("lgpl:redistribute", r"(this \w+ is free software )?you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license.*"),
    ("agpl:redistribute", r"(this \w+ is free software )?you can redistribute it and or modify it under the terms of the gnu affero general public license.*"),
    ("gpl:warranty", r"this \w+ is distributed in the hope that it will be useful but without any warranty.*"),
    ("gpl:copy", r"you should have received a copy of the gnu general public license along with this \w+.*"),
    ("lgpl:copy", r"you should have received a copy of the gnu (lesser|library) general public license along with this \w+.*"),
    ("agpl:copy", r"you should have received a copy of the gnu affero general public license along with this \w+.*"),
    ("epl-2:materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license (v)?2\.0.*"),
    ("epl-1:materials", r"(all rights reserved )?this program and the accompanying materials are made available under the terms of the eclipse public license (v)?1\.0.*"),
    ("bsd:binary", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation.*"),
    ("bsd:names", r"neither the name of .* nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd:asis", r"this software is provided by .* as is and any express or implied warranties.*"),
    ("isc:grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("copyright", r"(the )?copyright (c )?\d{4}.*"),
)
#: Ordered rules as (licence, identifiers in a row); an earlier rule takes what it matches from later ones.
RULES = (
    ("Apache-2.0", ("apache-2:ref", "apache-2:use", "apache-2:copy", "apache-2:asis", "apache-2:see")),
    ("MIT", ("mit:grant", "mit:notice", "mit:asis")),
    ("BSD-3-Clause", ("bsd:grant", "bsd:source", "bsd:binary", "bsd:names", "bsd:asis")),
    ("BSD-2-Clause", ("bsd:grant", "bsd:source", "bsd:binary", "bsd:asis")),
    ("GPL-any", ("gpl:redistribute", "gpl:warranty", "gpl:copy")),
    ("LGPL-any", ("lgpl:redistribute", "gpl:warranty", "lgpl:copy")),
    ("AGPL-any", ("agpl:redistribute", "gpl:warranty", "agpl:copy")),
    ("MPL-2.0", ("mpl-2:ref", "mpl-2:copy")),
    ("Zlib", ("zlib:asis", "zlib:grant")),
    ("OFL-1.1", ("ofl-1.1:ref", "ofl-1.1:see", "ofl-1.1:grant")),
    ("OFL-1.1", ("ofl-1.1:ref", "ofl-1.1:see")),
    ("Unlicense", ("unlicense:grant", "unlicense:see")),
    ("Apache-2.0", ("apache-2:ref", "apache-2:use", "apache-2:copy")),
    ("Apache-2.0", ("apache-2:ref",)),
    ("Apache-2.0", ("spdx:apache-2.0",)),
    ("MIT", ("mit:ref",)),
    ("MIT", ("mit:grant",)),
    ("MIT", ("spdx:mit",)),
    ("GPL-any", ("gpl-any:ref",)),
    ("GPL-3.0", ("gpl-3:ref",)),
    ("GPL-3.0", ("spdx:gpl-3.0",)),
    ("GPL-2.0", ("gpl-2:ref",)),
    ("GPL-2.0", ("spdx:gpl-2.0",)),
    ("GPL-any", ("gpl:redistribute",)),
    ("LGPL-any", ("lgpl-any:ref",)),
    ("LGPL-3.0", ("lgpl-3:ref",)),
    ("LGPL-3.0", ("spdx:lgpl-3.0",)),
    ("LGPL-2.1", ("lgpl-2.1:ref",)),
    ("LGPL-2.1", ("spdx:lgpl-2.1",)),
    ("LGPL-any", ("lgpl:redistribute",)),
    ("AGPL-3.0", ("agpl-3:ref",)),
    ("AGPL-3.0", ("spdx:agpl-3.0",)),
    ("AGPL-any", ("agpl:redistribute",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4:ref",)),
    ("CC-BY-NC-SA-4.0", ("spdx:cc-by-nc-sa-4.0",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4:ref",)),
    ("CC-BY-NC-ND-4.0", ("spdx:cc-by-nc-nd-4.0",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4:ref",)),
    ("CC-BY-NC-4.0", ("spdx:cc-by-nc-4.0",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4:ref",)),
    ("CC-BY-SA-4.0", ("spdx:cc-by-sa-4.0",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4:ref",)),
    ("CC-BY-ND-4.0", ("spdx:cc-by-nd-4.0",)),
    ("CC-BY-4.0", ("cc-by-4:ref",)),
    ("CC-BY-4.0", ("spdx:cc-by-4.0",)),
    ("CC0-1.0", ("cc0:ref",)),
    ("CC0-1.0", ("spdx:cc0-1.0",)),
    ("BSD-3-Clause", ("bsd-3:ref",)),
    ("BSD-3-Clause", ("spdx:bsd-3",)),
    ("BSD-2-Clause", ("bsd-2:ref",)),
    ("BSD-2-Clause", ("spdx:bsd-2",)),
    ("ISC", ("isc:ref",)),
    ("ISC", ("isc:grant",)),
    ("ISC", ("spdx:isc",)),
    ("MPL-2.0", ("mpl-2:ref",)),
    ("MPL-2.0", ("spdx:mpl-2.0",)),
    ("EPL-2.0", ("epl-2:materials",)),
    ("EPL-2.0", ("epl-2:ref",)),
    ("EPL-2.0", ("spdx:epl-2.0",)),
    ("EPL-1.0", ("epl-1:materials",)),
    ("EPL-1.0", ("epl-1:ref",)),
    ("EPL-1.0", ("spdx:epl-1.0",)),
    ("Zlib", ("zlib:ref",)),
    ("Zlib", ("zlib:grant",)),
    ("Zlib", ("spdx:zlib",)),
    ("BSL-1.0", ("bsl-1.0:ref",)),
    ("BSL-1.0", ("spdx:bsl-1.0",)),
    ("OFL-1.1", ("ofl-1.1:ref",)),
    ("OFL-1.1", ("ofl-1.1:grant",)),
    ("OFL-1.1", ("spdx:ofl-1.1",)),
    ("Unlicense", ("unlicense:grant",)),
    ("Unlicense", ("unlicense:ref",)),
    ("Unlicense", ("spdx:unlicense",)),
)
#: What brings a sentence to the form that is looked up, in order: numbers of a list go, versions are v2.0, what leads to a
#: licence's name becomes "under", what trails a name or a tag goes. Java's and RE2's syntax alike; groups as ``\1``.
FORMS = (
    (r"^[1-9] ", ""),
    (r"\bv(ersion)?[. ]*([0-9])", r"v\2"),
    (r"^(this (\w+ )?\w+ is )?(licensed|released|distributed|dedicated|available|made available) (under|to) (a |the )?(terms of (a |the )?)?", "under "),
    (r"^under (.* 4\.0)( international)?( public)?( license)?$", r"under \1"),
    (r"^under cc0 1\.0.*$", "under cc0 1.0"),
    (rf"^spdx license identifier ({'|'.join(t.replace('.', chr(92) + '.') for _, t in TAGS)})( .*)?$", r"spdx \1"),
)
#: Forms to identifiers.
KNOWN = {form: name for name, forms in SENTENCES for form in forms} | {f"under {n}": name for name, names in NAMES for n in names} | {f"spdx {tag}": name for name, tag in TAGS}
#: Buckets of the literal in which a form is looked up; each holds a few forms.
SLOTS = 64
#: Ends a sentence: stop marks before white space, blank lines; a stop mark inside a word or number doesn't.
#: Patterns here keep to what Java's and RE2's syntax share, so that the same text runs in SQL.
STOP, OPENER = r"[.!?;]\s+|\n[\s#*/-]*\n", rf"\n[\s#*/;-]*({OPENERS})"
#: A stop mark in a version ends no sentence.
VERSION = r"\bv\.\s*([0-9])"
MARK = "\x01"


def sentences(text: Column) -> Column:
    """The text's normalised sentences: lower case, comment signs, quotes and brackets gone, single spaces, no end mark."""
    numbered = F.regexp_replace(F.lower(text), VERSION, "v$1")
    cut = F.regexp_replace(F.regexp_replace(numbered, OPENER, MARK + "$1"), STOP, MARK)
    plain = F.regexp_replace(F.regexp_replace(cut, r"""[\s#*/"'()<>=:;_-]+""", " "), rf"[.,!? ]*{MARK}[.,!? ]*", MARK)
    return F.split(F.regexp_replace(F.replace(plain, F.lit(" ,"), F.lit(",")), r"^[.,!? ]+|[.,!? ]+$", ""), MARK)


def identifier(sentence: Column) -> Column:
    """The identifier of a known licence sentence, else null.

    The sentence's form is looked up in one of ``SLOTS`` maps, by its checksum; only forms that aren't known meet patterns.
    """
    form = F.replace(sentence, F.lit(","), F.lit(""))
    for pattern, to in FORMS:
        form = F.regexp_replace(form, pattern, to.replace("\\", "$"))
    slots: list[list[tuple[str, str | None]]] = [[("", None)] for _ in range(SLOTS)]
    for known, name in KNOWN.items():
        slots[zlib.crc32(known.encode()) % SLOTS].append((known, name))
    table = F.array(*[F.create_map(*[F.lit(x).cast("string") for pair in slot for x in pair]) for slot in slots])

    def named(f: Column) -> Column:
        free = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, pattern in PATTERNS:
            free = free.when(f.rlike(f"^(?:{pattern})$"), F.lit(name))
        return F.coalesce(F.try_element_at(F.get(table, F.pmod(F.crc32(f.cast("binary")), F.lit(SLOTS)).cast("int")), f), free)

    # the form is made once, as the element of an array, not anew for each pattern
    return F.get(F.transform(F.array(form), named), F.lit(0))


def rule_matches(sequence: Column) -> tuple[Column, Column]:
    """(licences in rule order, identifiers that no rule took) of a sequence written as ``<id><id>``."""
    found, left = [], sequence
    for name, ids in RULES:
        marks = "".join(f"<{i}>" for i in ids)
        found.append(F.when(F.contains(left, F.lit(marks)), F.lit(name)))
        left = F.replace(left, F.lit(marks), F.lit("|"))
    return F.array_distinct(F.array_compact(F.array(*found))), left


def scan(docs: DataFrame) -> DataFrame:
    """For every row of ``docs(doc_id, text)``: doc_id, sentence_ids, licenses, unmatched_ids (each joined by a space), n_sentences_known.

    ``sentence_ids`` are in the order of the text; ``licenses`` in the order of the rules, each once;
    ``unmatched_ids`` are known sentences that belong to no rule's sequence. Null and empty texts have none. Rows
    that repeat are scanned each; other columns are ignored; an empty table gives an empty table.
    """
    rows = docs.select("doc_id", "text", F.lower("text").rlike(ANCHORS).alias("__anchor"))
    known = F.filter(F.transform(sentences(F.col("text")), identifier), lambda i: i.isNotNull())
    none = F.array().cast("array<string>")
    found = rows.select("doc_id", F.when(F.col("__anchor"), known).otherwise(none).alias("ids"))
    found = found.withColumn("sequence", F.when(F.size("ids") > 0, F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">"))).otherwise(F.lit("")))
    licences, left = rule_matches(F.col("sequence"))
    return found.select(
        "doc_id",
        F.array_join("ids", " ").alias("sentence_ids"),
        F.when(F.col("sequence") == "", F.lit("")).otherwise(F.array_join(licences, " ")).alias("licenses"),
        F.trim(F.regexp_replace(F.regexp_replace(left, r"[<>|]+", " "), " +", " ")).alias("unmatched_ids"),
        F.size("ids").cast("long").alias("n_sentences_known"),
    )


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle() -> str:
    """The same scan in SQL."""
    form = "replace(s, ',', '')"
    for pattern, to in FORMS:
        form = f"regexp_replace({form}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    held = "map {" + ", ".join(f"{_quoted(k)}: {_quoted(n)}" for k, n in KNOWN.items()) + "}"
    names = f"when {held}[s] is not null then {held}[s] " + " ".join(f"when regexp_full_match(s, {_quoted(p)}) then {_quoted(n)}" for n, p in PATTERNS)
    steps, left, found = [], "sequence", []
    for k, (name, ids) in enumerate(RULES):
        marks = _quoted("".join(f"<{i}>" for i in ids))
        steps.append(f"q{k} as (select *, replace({left}, {marks}, '|') as l{k}, case when contains({left}, {marks}) then {_quoted(name)} end as f{k} from {'seq' if not k else f'q{k - 1}'})")
        left = f"l{k}"
        found.append(f"f{k}")
    mark = "chr(1)"
    return f"""
        with cut as (
            select doc_id, row_number() over () as r,
                   regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), {_quoted(VERSION)}, 'v\\1', 'g'), {_quoted(OPENER)}, {mark} || '\\1', 'g'), {_quoted(STOP)}, {mark}, 'g') as t
            from documents
        ), plain as (
            select doc_id, r, regexp_replace(replace(regexp_replace(regexp_replace(t, {_quoted(chr(91) + r"\s#*/" + chr(34) + "'" + r"()<>=:;_-]+")}, ' ', 'g'),
                   '[.,!? ]*' || {mark} || '[.,!? ]*', {mark}, 'g'), ' ,', ','), '^[.,!? ]+|[.,!? ]+$', '', 'g') as t
            from cut
        ), named as (
            select doc_id, r, list_filter(list_transform(list_transform(string_split(t, {mark}), lambda s: {form}), lambda s: case {names} end), lambda i: i is not null) as ids from plain
        ), seq as (
            select *, case when len(ids) > 0 then '<' || array_to_string(ids, '><') || '>' else '' end as sequence from named
        ), {", ".join(steps)}
        select doc_id, coalesce(array_to_string(ids, ' '), '') as sentence_ids,
               coalesce(array_to_string(list_filter([{", ".join(f"case when {f} is not null and not coalesce(list_contains([{', '.join(found[:i])}]::varchar[], {f}), false) then {f} end" for i, f in enumerate(found))}], lambda i: i is not null), ' '), '') as licenses,
               trim(regexp_replace(regexp_replace({left}, '[<>|]+', ' ', 'g'), ' +', ' ', 'g')) as unmatched_ids,
               len(ids)::bigint as n_sentences_known
        from q{len(RULES) - 1}
    """
