"""Licence scans by sentence rules.

Every text is cut into sentences twice: at sentence ends and line ends, and at
sentence ends and blank lines (for notices that are wrapped). A sentence is
normalised (lower case, runs of anything but ASCII letters and digits to one
space) and looked up among the known licence sentences. What is found gives a
sequence of sentence identifiers in text order; more than ``MAX_GAP`` unknown
sentences in a row break it. The ordered rules, longest first, are matched
against the sequence, each taking what it matches out of it, so that a short
notice inside a long licence is not reported twice.

One scan and one projection, no shuffle: sentences and rules are literals
whose number is fixed by the tables below, not by the data.

Result: ``doc_id, rule, license, hits``, a row for each rule that a row of the
input matches. Null, empty and sentence-free texts match nothing. Rows are
scanned one by one, so repeated rows give repeated results and a null
``doc_id`` is reported as such. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import col, documents

MAX_GAP = 2


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


#: identifier: the sentence as licences have it.
SENTENCES = {
    "mit-name": "MIT License",
    "mit-the-name": "The MIT License (MIT)",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-this": "This project is licensed under the MIT License.",
    "mit-grant": (
        'Permission is hereby granted, free of charge, '
        'to any person obtaining a copy of '
        'this software and associated documentation files (the '
        '"Software"), to deal in the Software without '
        'restriction, including without limitation the rights to '
        'use, copy, modify, merge, publish, distribute, sublicense, '
        'and/or sell copies of the Software, and '
        'to permit persons to whom the Software '
        'is furnished to do so, subject to '
        'the following conditions:'
    ),
    "mit-notice": (
        "The above copyright notice and this permission "
        "notice shall be included in all copies "
        "or substantial portions of the Software."
    ),
    "as-is-software": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT '
        'WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
        'INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
        'OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE '
        'AND NONINFRINGEMENT.'
    ),
    "no-liability": (
        "IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-license": (
        'Licensed under the Apache License, Version 2.0 '
        '(the "License"); you may not use this '
        'file except in compliance with the License.'
    ),
    "apache-obtain": (
        "You may obtain a copy of the "
        "License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "apache-obtain-s": (
        "You may obtain a copy of the "
        "License at https://www.apache.org/licenses/LICENSE-2.0"
    ),
    "apache-unless": (
        'Unless required by applicable law or agreed '
        'to in writing, software distributed under the '
        'License is distributed on an "AS IS" '
        'BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        'KIND, either express or implied.'
    ),
    "apache-see": (
        "See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "gpl3-work": (
        "This work is licensed under the GNU "
        "General Public License, version 3."
    ),
    "gpl2-work": (
        "This work is licensed under the GNU "
        "General Public License, version 2."
    ),
    "gpl3-free": (
        "This program is free software: you can "
        "redistribute it and/or modify it under the "
        "terms of the GNU General Public License "
        "as published by the Free Software Foundation, "
        "either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "gpl2-free": (
        "This program is free software; you can "
        "redistribute it and/or modify it under the "
        "terms of the GNU General Public License "
        "as published by the Free Software Foundation; "
        "either version 2 of the License, or "
        "(at your option) any later version."
    ),
    "lgpl21-free": (
        "This library is free software; you can "
        "redistribute it and/or modify it under the "
        "terms of the GNU Lesser General Public "
        "License as published by the Free Software "
        "Foundation; either version 2.1 of the License, "
        "or (at your option) any later version."
    ),
    "gnu-hope": (
        "This program is distributed in the hope "
        "that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty "
        "of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE."
    ),
    "gnu-hope-library": (
        "This library is distributed in the hope "
        "that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty "
        "of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE."
    ),
    "gnu-details": "See the GNU General Public License for more details.",
    "lgpl-details": (
        "See the GNU Lesser General Public License "
        "for more details."
    ),
    "bsd-grant": (
        "Redistribution and use in source and binary "
        "forms, with or without modification, are permitted "
        "provided that the following conditions are met:"
    ),
    "bsd-source": (
        "Redistributions of source code must retain the "
        "above copyright notice, this list of conditions "
        "and the following disclaimer."
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions "
        "and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder "
        "nor the names of its contributors may "
        "be used to endorse or promote products "
        "derived from this software without specific prior "
        "written permission."
    ),
    "bsd-as-is": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT '
        'HOLDERS AND CONTRIBUTORS "AS IS" AND ANY '
        'EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        'LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
        'AND FITNESS FOR A PARTICULAR PURPOSE ARE '
        'DISCLAIMED.'
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute "
        "this software for any purpose with or "
        "without fee is hereby granted, provided that "
        "the above copyright notice and this permission "
        "notice appear in all copies."
    ),
    "mpl2-source": (
        "This Source Code Form is subject to "
        "the terms of the Mozilla Public License, "
        "v. 2.0."
    ),
    "mpl2-head": (
        "This Source Code Form is subject to "
        "the terms of the Mozilla Public License, "
        "v."
    ),
    "mpl2-tail": "2.0.",
    "mpl2-copy": (
        "If a copy of the MPL was "
        "not distributed with this file, You can "
        "obtain one at http://mozilla.org/MPL/2.0/"
    ),
    "unlicense": (
        "This is free and unencumbered software released "
        "into the public domain."
    ),
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-4-work": (
        "This work is licensed under a Creative "
        "Commons Attribution 4.0 International License."
    ),
    "cc-by-sa-4-work": (
        "This work is licensed under a Creative "
        "Commons Attribution-ShareAlike 4.0 International License."
    ),
    "cc-by-nc-4-work": (
        "This work is licensed under a Creative "
        "Commons Attribution-NonCommercial 4.0 International License."
    ),
    "cc0": (
        "To the extent possible under law, the "
        "author has waived all copyright and related "
        "or neighboring rights to this work."
    ),
}


class Rule(NamedTuple):
    """A licence is recognised where ``sentences`` follow each other in a sequence of known sentences."""

    name: str
    license: str
    sentences: tuple[str, ...]


_RULES = (
    Rule("mit-text", "MIT", ("mit-grant", "mit-notice", "as-is-software", "no-liability")),
    Rule("apache-header", "Apache-2.0", ("apache-license", "apache-obtain", "apache-unless", "apache-see")),
    Rule("apache-header-https", "Apache-2.0", ("apache-license", "apache-obtain-s", "apache-unless", "apache-see")),
    Rule("bsd-3-text", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    Rule("bsd-2-text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    Rule("gpl3-header", "GPL-3.0-or-later", ("gpl3-free", "gnu-hope", "gnu-details")),
    Rule("gpl2-header", "GPL-2.0-or-later", ("gpl2-free", "gnu-hope", "gnu-details")),
    Rule("lgpl21-header", "LGPL-2.1-or-later", ("lgpl21-free", "gnu-hope-library", "lgpl-details")),
    Rule("mpl2-header", "MPL-2.0", ("mpl2-head", "mpl2-tail", "mpl2-copy")),
    Rule("mpl2-header-joined", "MPL-2.0", ("mpl2-source", "mpl2-copy")),
    *(
        Rule(s, licence, (s,))
        for licence, names in (
            ("MIT", ("mit-name", "mit-the-name", "mit-released", "mit-licensed", "mit-this", "mit-grant")),
            ("Apache-2.0", ("apache-short", "apache-license")),
            ("GPL-3.0-only", ("gpl3-work",)),
            ("GPL-3.0-or-later", ("gpl3-free",)),
            ("GPL-2.0-only", ("gpl2-work",)),
            ("GPL-2.0-or-later", ("gpl2-free",)),
            ("LGPL-2.1-or-later", ("lgpl21-free",)),
            ("ISC", ("isc-grant",)),
            ("MPL-2.0", ("mpl2-source",)),
            ("Unlicense", ("unlicense",)),
            ("CC-BY-NC-4.0", ("cc-by-nc-4", "cc-by-nc-4-work")),
            ("CC-BY-4.0", ("cc-by-4", "cc-by-4-work")),
            ("CC-BY-SA-4.0", ("cc-by-sa-4", "cc-by-sa-4-work")),
            ("CC0-1.0", ("cc0",)),
        )
        for s in names
    ),
)
#: Longest first; equal lengths in the order above.
RULES = tuple(sorted(_RULES, key=lambda r: -len(r.sentences)))

#: A break in a sequence, and an identifier in one; neither occurs in the other.
BREAK = "|"


def token(sentence_id: str) -> str:
    return f"<{sentence_id}>"


def pattern(rule: Rule) -> str:
    return "".join(map(token, rule.sentences))


#: Regex of the cuts of each reading of a text. Sentence ends are kept with their sentence.
READINGS = (("([.!?])[ \\t]+|\\n", "lines"), ("([.!?])\\s+|\\n[ \\t\\r]*\\n", "paragraphs"))
_CUT = "\u0001"


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES, max_gap: int = MAX_GAP) -> DataFrame:
    by_text = {normal(v): k for k, v in sentences.items()}
    ids = F.create_map(*[F.lit(x) for kv in by_text.items() for x in (kv[0], token(kv[1]))])
    text = F.coalesce(col("text"), F.lit(""))

    def sequence(cut: str):
        units = F.split(F.regexp_replace(text, cut, "$1" + _CUT), _CUT)
        named = F.transform(units, lambda u, i: F.struct(i.alias("at"), F.trim(F.regexp_replace(F.lower(u), "[^a-z0-9]+", " ")).alias("unit")))
        known = F.filter(named, lambda x: x["unit"].isin(*by_text))
        start = F.struct(F.lit("").alias("seq"), F.lit(-1).alias("at"))
        step = lambda acc, x: F.struct(F.concat(acc["seq"], F.when((acc["at"] >= 0) & (x["at"] - acc["at"] > max_gap + 1), BREAK).otherwise(""), F.element_at(ids, x["unit"])).alias("seq"), x["at"].alias("at"))
        return F.aggregate(known, start, step, lambda acc: acc["seq"])

    table = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.license).alias("license"), F.lit(pattern(r)).alias("pattern")) for r in rules])

    def matches(seq):
        """The rules in order, each taking out of the sequence what it matches."""
        none = F.slice(F.array(F.struct(F.lit("").alias("rule"), F.lit("").alias("license"), F.lit(0).alias("hits"))), 1, 0)
        start = F.struct(seq.alias("seq"), none.alias("found"))

        def step(acc, r):
            left = F.replace(acc["seq"], r["pattern"], F.lit(BREAK))
            n = ((F.length(acc["seq"]) - F.length(left)) / (F.length(r["pattern"]) - 1)).cast("int")
            hit = F.struct(r["rule"].alias("rule"), r["license"].alias("license"), n.alias("hits"))
            return F.struct(left.alias("seq"), F.when(n > 0, F.array_append(acc["found"], hit)).otherwise(acc["found"]).alias("found"))

        return F.aggregate(table, start, step, lambda acc: acc["found"])

    read = docs.select(col("doc_id").alias("doc_id"), *[sequence(cut).alias(name) for cut, name in READINGS])
    # A reading counts where it finds more; the two see the same sentences of unwrapped text.
    found = read.where("lines <> '' OR paragraphs <> ''").select("doc_id", *[matches(F.col(name)).alias(name) for _, name in READINGS])
    names = F.array_distinct(F.concat(*[F.transform(F.col(name), lambda x: F.struct(x["rule"].alias("rule"), x["license"].alias("license"))) for _, name in READINGS]))
    hits = lambda name, r: F.coalesce(F.try_element_at(F.transform(F.filter(F.col(name), lambda x: x["rule"] == r), lambda x: x["hits"]), F.lit(1)), F.lit(0))
    rows = found.select("doc_id", "lines", "paragraphs", F.explode(names).alias("r"))
    return rows.select("doc_id", F.col("r.rule").alias("rule"), F.col("r.license").alias("license"), F.greatest(*[hits(name, F.col("r.rule")) for _, name in READINGS]).cast("long").alias("hits"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(normal(v))}, {q(token(k))})" for k, v in SENTENCES.items())
    units = " UNION ALL ".join(
        f"SELECT doc_id, {q(name)} AS reading, unnest(range(len(us))) AS i, unnest(us) AS u FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), {q(cut)}, '\\1' || chr(1), 'g'), chr(1)) AS us FROM documents)"
        for cut, name in READINGS
    )
    ctes = [
        f"known(unit, tok) AS (VALUES {known})",
        f"units AS ({units})",
        "hits AS (SELECT doc_id, reading, i, tok FROM (SELECT doc_id, reading, i, trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')) AS unit FROM units) JOIN known USING (unit))",
        f"gaps AS (SELECT *, i - lag(i) OVER (PARTITION BY doc_id, reading ORDER BY i) > {MAX_GAP + 1} AS gap FROM hits)",
        "s0 AS (SELECT doc_id, reading, string_agg(CASE WHEN gap THEN '|' ELSE '' END || tok, '' ORDER BY i) AS seq FROM gaps GROUP BY ALL)",
    ]
    parts = []
    for k, r in enumerate(RULES):
        p = pattern(r)
        ctes.append(f"s{k + 1} AS (SELECT doc_id, reading, replace(seq, {q(p)}, '|') AS seq, CAST((length(seq) - length(replace(seq, {q(p)}, '|'))) / {len(p) - 1} AS BIGINT) AS n FROM s{k})")
        parts.append(f"SELECT doc_id, {q(r.name)} AS rule, {q(r.license)} AS license, n FROM s{k + 1} WHERE n > 0")
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, rule, license, max(n) AS hits FROM (" + " UNION ALL ".join(parts) + ") GROUP BY doc_id, rule, license"


ORACLE_SQL = _oracle()
