"""License scans by sentence rules.

A text is cut into pieces at sentence and line ends (lines that go on in lower
case joined first), each normalised to its lower-case words. A known licence
sentence is a run of pieces with its words, however wrapped or cut by full
stops inside; runs map to an identifier, the longest first. The sequence of a
document's identifiers is then matched against ordered rules,
longest first: a rule names a licence, needs its identifiers in a row, and
uses them up. The tables are a few kB and travel with the task; no shuffle.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import append, field, prepare, utf8

# Sentences of public licences and the rules over them.
SPDX = ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
        "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "CC-BY-4.0", "CC-BY-SA-4.0",
        "CC-BY-NC-4.0", "CC0-1.0", "Unlicense")
SENTENCES = {
    "mit-name": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "mit-title": ["The MIT License (MIT)", "MIT License", "The MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "apache-name": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "apache-file": ["you may not use this file except in compliance with the License."],
    "apache-both": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "gpl3-name": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "gpl2-name": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "gpl2-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl21-name": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU Lesser General Public License, version 2.1."],
    "lgpl21-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-name": ["This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Lesser General Public License, version 3."],
    "lgpl3-later": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl3-name": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License, version 3."],
    "agpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mpl2-name": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ccbync-name": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "ccby-name": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "ccbysa-name": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "cc0-name": ["Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0."],
    "unlicense-name": ["This is free and unencumbered software released into the public domain."],
    "reserved": ["All rights reserved."],
}
# Sentences with a name inside: identifier -> (words before it, words after it).
SLOTS = {"bsd-endorse": ("Neither the name of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")}
RULES = [
    ("MIT", ("mit-title", "mit-grant", "mit-notice")), ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-both", "apache-copy")), ("Apache-2.0", ("apache-name", "apache-file", "apache-copy")),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-warranty")), ("GPL-3.0-or-later", ("gpl3-later", "gpl-warranty")),
    ("LGPL-2.1-or-later", ("lgpl21-later", "gpl-warranty")), ("LGPL-3.0-or-later", ("lgpl3-later", "gpl-warranty")), ("AGPL-3.0-or-later", ("agpl3-later", "gpl-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-endorse")), ("BSD-2-Clause", ("bsd-grant",)),
    ("MIT", ("mit-name",)), ("Apache-2.0", ("apache-name",)), ("Apache-2.0", ("apache-both",)),
    ("GPL-2.0-only", ("gpl2-name",)), ("GPL-3.0-only", ("gpl3-name",)), ("GPL-2.0-or-later", ("gpl2-later",)), ("GPL-3.0-or-later", ("gpl3-later",)),
    ("LGPL-2.1-only", ("lgpl21-name",)), ("LGPL-3.0-only", ("lgpl3-name",)), ("AGPL-3.0-only", ("agpl3-name",)),
    ("LGPL-2.1-or-later", ("lgpl21-later",)), ("LGPL-3.0-or-later", ("lgpl3-later",)), ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("ISC", ("isc-grant",)), ("MPL-2.0", ("mpl2-name",)), ("CC-BY-NC-4.0", ("ccbync-name",)), ("CC-BY-4.0", ("ccby-name",)),
    ("CC-BY-SA-4.0", ("ccbysa-name",)), ("CC0-1.0", ("cc0-name",)), ("Unlicense", ("unlicense-name",)),
    *((x, (f"spdx-{x.lower()}",)) for x in SPDX),
]

_TAG = re.compile(rb"(SPDX-License-Identifier:[ \t]*[^ \t\n]+)")
_WRAP = re.compile(rb"\n[ \t*#/;]*([a-z])")
_END = re.compile(rb"[.!?][ \t\r\n]+|\n")
_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def normalise(sentence: bytes) -> bytes:
    """Lower-case words and numbers, one space between."""
    return b" ".join(sentence.translate(_WORDS).split())


def sentences(text: bytes) -> list[bytes]:
    """Normalised sentences: cut at sentence ends and line ends, after joining
    a line that goes on with a lower-case letter to the one before (but none
    to an SPDX tag)."""
    return [normalise(s) for s in _END.split(_WRAP.sub(rb" \1", _TAG.sub(rb"\1\n", text)))]


def known_sentences() -> dict[bytes, str]:
    out = {normalise(s.encode()): i for i, all_ in SENTENCES.items() for s in all_}
    out.update({normalise(f"SPDX-License-Identifier: {x}".encode()): f"spdx-{x.lower()}" for x in SPDX})
    return out


def finder():
    """f(pieces) -> identifiers of the known sentences that runs of pieces
    spell, in order; at each piece the longest run counts. A name in a slot
    may itself be cut into pieces, but ends with its paragraph."""
    known = known_sentences()
    begun = {s[:k] for s in known for k, c in enumerate(s) if c == 0x20} | set(known)
    slots = [(i, normalise(a.encode()), b" " + normalise(b.encode())) for i, (a, b) in SLOTS.items()]

    def run(pieces: list[bytes], at: int) -> tuple[str | None, int]:
        found, end, words, k = None, at + 1, pieces[at], at
        while words in begun:
            if words in known:
                found, end = known[words], k + 1
            k += 1
            while k < len(pieces) and not pieces[k]:   # blank lines may part a sentence from its URL
                k += 1
            if k == len(pieces):
                break
            words += b" " + pieces[k]
        return found, end

    def slot(pieces: list[bytes], at: int) -> tuple[str | None, int]:
        for i, head, tail in slots:
            if not (pieces[at] + b" ").startswith(head + b" "):
                continue
            words, k = pieces[at][len(head):], at
            while not (words.endswith(tail) and len(words) > len(tail)):
                k += 1
                if k == len(pieces) or not pieces[k] or (pieces[k] + b" ").startswith(head + b" "):
                    break
                words = (words + b" " + pieces[k])[-len(tail) - 1:]
            else:
                return i, k + 1
        return None, at + 1

    def f(pieces: list[bytes]) -> list[str]:
        out, at = [], 0
        while at < len(pieces):
            found, end = run(pieces, at) if pieces[at] in begun else (None, at + 1)
            if not found:
                found, end = slot(pieces, at)
            if found:
                out.append(found)
            at = end
        return out
    return f


def match_rules(ids: list[str]) -> list[str]:
    """Licences by the ordered rules; identifiers in a row, each used once."""
    row, out = "," + ",,".join(ids) + "," if ids else "", []
    for name, need in RULES:
        pattern = "," + ",,".join(need) + ","
        if pattern in row:
            out.append(name)
            row = row.replace(pattern, "|")
    return sorted(set(out))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with sentence_ids (identifiers of the known sentences, in
    order) and licenses (names by the rules, sorted). Null and empty texts
    have neither. Texts of any length are scanned whole, each row by itself,
    also one that repeats; an empty table gives an empty result."""
    prepare(docs.sparkSession)

    def factory():
        find = finder()

        def f(ts):
            ids = [find(sentences(t)) for t in ts.to_pylist()]
            return [pa.array(ids, pa.list_(pa.string())), pa.array([match_rules(x) for x in ids], pa.list_(pa.string()))]
        return f

    return append(docs, [utf8(text)], [field("sentence_ids", "array<string>"), field("licenses", "array<string>")], factory)


def duckdb_sql() -> str:
    """The same scan in DuckDB: known sentences as rows, rules as nested replacements."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    known = ", ".join(f"({q(s.decode())}, {q(i)})" for s, i in known_sentences().items())
    steps = []
    for k, (_, need) in enumerate(RULES):
        p = q("," + ",,".join(need) + ",")
        steps.append(f"s{k + 1} AS (SELECT doc_id, ids, replace(r, {p}, '|') AS r, found || CASE WHEN contains(r, {p}) THEN [{q(RULES[k][0])}] ELSE [] END AS found FROM s{k})")
    return f"""
WITH known(s, i) AS (VALUES {known}),
cut AS (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '(SPDX-License-Identifier:[ \\t]*[^ \\t\\n]+)', '\\1' || chr(10), 'g'), '\\n[ \\t*#/;]*([a-z])', ' \\1', 'g'), '[.!?][ \\t\\r\\n]+|\\n') AS xs FROM documents),
one AS (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS n FROM cut),
norm AS (SELECT doc_id, n, trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g')) AS s FROM one),
hit AS (SELECT doc_id, string_agg(i, ',' ORDER BY n) AS ids FROM norm JOIN known USING (s) GROUP BY doc_id),
s0 AS (SELECT doc_id, coalesce(ids, '') AS ids, CASE WHEN ids IS NULL THEN '' ELSE ',' || replace(ids, ',', ',,') || ',' END AS r, CAST([] AS VARCHAR[]) AS found FROM documents LEFT JOIN hit USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, ids AS sentence_ids, array_to_string(list_sort(list_distinct(found)), ',') AS licenses, len(found) > 0 AS licensed FROM s{len(RULES)}"""
