"""Licence recognition by sentence identifiers and ordered rules (DataFrame functions only).

A text is cut into sentences: at ; ! ? : at full stops before white space, and at lines without
letters or digits. Single line breaks do not end a sentence, as licences are printed wrapped. Each
sentence is normalised (ASCII lower case, runs of other than letters and digits become one blank)
and looked up among known licence sentences, in a hash set; one that is not known is tried again
without its first line (a copyright line has no full stop) and then line by line (notices stand on
lines of their own). The identifiers found, in order, form a sequence. Ordered rules then consume that
sequence: the first rule whose identifiers occur in it as a consecutive run wins its place, its
identifiers are taken out, and later rules see the rest. Identifiers that no rule consumes are
reported as unmatched.

The known sentences are those of printed licences and licence headers (`PRINTED`), cut by the same
rules, and one-line notices (`NOTICES`); a printed text is also a rule over its own identifiers.

Everything is one narrow projection over the scan: no shuffle, no join, so hot sources or copies
cost nothing beyond their own bytes. The tables of sentences and rules are parameters of bounded,
documented size (`MAX_TABLE`) because they travel inside the plan.

Defined edge cases: null and empty texts have no sentence and yield empty strings; repeated
sentences repeat their identifier; sentences of any length are looked up; input columns named
sentence_ids, licenses or unmatched are replaced, all others are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, table

#: Most sentences and rules that one plan may carry.
MAX_TABLE = 5000

# Texts of public licences and the usual notices.
#: (identifier, one-line notice)
NOTICES: tuple[tuple[str, str], ...] = (
    ("gplVer3", "This work is licensed under the GNU General Public License, version 3"),
    ("gplVer2", "This work is licensed under the GNU General Public License, version 2"),
    ("ccByNc4", "Licensed under CC BY-NC 4.0"),
    ("ccBy4", "Licensed under CC BY 4.0"),
    ("ccBySa4", "Licensed under CC BY-SA 4.0"),
    ("ccBy4Long", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("ccBySa4Long", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("ccByNc4Long", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("mitReleased", "Released under the MIT License"),
    ("mitLicensed", "Licensed under the MIT License"),
    ("apache2", "Licensed under the Apache License, Version 2.0"),
    ("mitPerm", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("asIs", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND"),
    ("bsdSource", "Redistributions of source code must retain the above copyright notice"),
    ("bsdBinary", "Redistributions in binary form must reproduce the above copyright notice"),
    ("orLater", "or (at your option) any later version"),
    ("allRights", "All rights reserved"),
)

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:"""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at"""
_APACHE_END = """Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""
#: (licence, its text or header as printed); longer texts precede their parts.
PRINTED: tuple[tuple[str, str], ...] = (
    ("MIT", f"{_GRANT}\n\nThe above copyright notice and this permission notice shall be included in all copies or "
            f"substantial portions of the Software.\n\n{_AS_IS}"),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("Apache-2.0", f"{_APACHE}\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n{_APACHE_END}"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"{_ISC}.\n\n{_ISC_END}"),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom
the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works
of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("AGPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
your option) any later version."""),
    ("AGPL-3.0-only", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
Affero General Public License as published by the Free Software Foundation, version 3."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version."""),
    ("GPL-3.0-only", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, version 3."""),
    ("GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
option) any later version."""),
    ("GPL-2.0-only", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation; version 2 of the License."""),
    ("LGPL-3.0-or-later", """This library is free software: you can redistribute it and/or modify it under the terms of the
GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
your option) any later version."""),
    ("LGPL-2.1-or-later", """This library is free software; you can redistribute it and/or modify it under the terms of the
GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
your option) any later version."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at"""),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public
License 2.0 which is available at"""),
    ("Artistic-2.0", """You are permitted to use, modify and distribute this package under the terms of the Artistic License
2.0."""),
    ("CC0-1.0", """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring
rights to this software to the public domain worldwide. This software is distributed without any warranty."""),
    # parts that still prove a licence
    ("MIT", f"{_GRANT}\n\nThe above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("MIT", _GRANT),
    ("BSD-3-Clause", _BSD + _BSD_THIRD),
    ("BSD-2-Clause", _BSD),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("Apache-2.0", _APACHE_END),
)
#: (licence, identifiers in order) of notices; after the printed texts.
NOTICE_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("GPL-3.0-or-later", ("gplVer3", "orLater")),
    ("GPL-2.0-or-later", ("gplVer2", "orLater")),
    ("GPL-3.0-only", ("gplVer3",)),
    ("GPL-2.0-only", ("gplVer2",)),
    ("MIT", ("mitReleased",)),
    ("MIT", ("mitLicensed",)),
    ("MIT", ("mitPerm",)),
    ("Apache-2.0", ("apache2",)),
    ("CC-BY-NC-4.0", ("ccByNc4",)),
    ("CC-BY-SA-4.0", ("ccBySa4",)),
    ("CC-BY-4.0", ("ccBy4",)),
    ("CC-BY-NC-4.0", ("ccByNc4Long",)),
    ("CC-BY-SA-4.0", ("ccBySa4Long",)),
    ("CC-BY-4.0", ("ccBy4Long",)),
    ("LicenseRef-proprietary", ("allRights",)),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sentences end at ; ! ? : at full stops before white space or the end, and at lines without letters or digits.
BREAK = r"\n[^a-z0-9\n]*(?:\n[^a-z0-9\n]*)+|[;!?:]+|\.(?:[ \t\n]|\z)"
#: What stands between sentences once a text is cut.
CUT = "\u0002"


def normal(sentence: str) -> str:
    """The form in which sentences are compared; the same rules as `_cut` has on columns."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in sentence)
    return " ".join("".join(c if c in LOWER or c in "0123456789" else " " for c in folded).split())


def sentences_of(text: str) -> list[str]:
    """The normal forms of a printed text's sentences."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    parts = re.split(BREAK.replace(r"\z", r"\Z"), folded)
    return [n for n in map(normal, parts) if n]


def _known() -> tuple[dict[str, str], tuple[tuple[str, tuple[str, ...]], ...]]:
    """Identifiers by normal form, and the rules: printed texts first."""
    known = {normal(s): i for i, s in NOTICES}
    rules, made = [], {}
    for name, text in PRINTED:
        ids = []
        for n in sentences_of(text):
            if n not in known:
                made[name] = made.get(name, 0) + 1
                known[n] = f"{name}/{made[name]}"
            ids.append(known[n])
        rules.append((name, tuple(ids)))
    return known, (*rules, *NOTICE_RULES)


KNOWN, RULES = _known()


def _cut(text: Column) -> Column:
    """Sentences as arrays' items: normalised, but for line breaks."""
    folded = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"\r\n?", "\n")
    cut = F.regexp_replace(folded, BREAK, CUT)
    plain = F.regexp_replace(cut, rf"[^a-z0-9\n{CUT}]+", " ")
    return F.split(F.regexp_replace(plain, " ?\n ?", "\n"), CUT)


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def recognise(
    docs: DataFrame,
    text: str = "text",
    known: dict[str, str] = KNOWN,
    rules: Sequence[tuple[str, Sequence[str]]] = RULES,
) -> DataFrame:
    """`docs` with sentence_ids, licenses and unmatched: comma-joined strings.

    sentence_ids: identifiers in text order; licenses: names of the rules that matched, in rule
    order, each once; unmatched: identifiers left over. `known`: identifiers by normal form.
    """
    if max(len(known), len(rules)) > MAX_TABLE:
        raise ValueError(f"at most {MAX_TABLE} sentences and rules")
    pairs = ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in known.items())
    names, least = list(known), min(map(len, known))
    none = F.array().cast("array<string>")
    flat = lambda p: F.trim(F.replace(p, F.lit("\n"), F.lit(" ")))

    def look(part: Column) -> Column:
        at = F.instr(part, "\n")
        first, rest = F.trim(F.substr(part, F.lit(1), at - 1)), flat(F.substr(part, at + 1))
        lines = F.filter(F.transform(F.split(part, "\n"), F.trim), lambda s: s.isin(names))
        return (
            F.when(flat(part).isin(names), F.array(flat(part))).when(at == 0, none)
            .when(rest.isin(names), F.filter(F.array(first, rest), lambda s: s.isin(names))).otherwise(lines)
        )

    # a normal form is never longer than what it was made from
    parts = F.filter(F.transform(_cut(F.col(text)), lambda s: F.btrim(s, F.lit(" \n"))), lambda s: F.length(s) >= least)
    ids = F.transform(F.flatten(F.transform(parts, look)), lambda s: F.element_at(F.expr(f"map({pairs})"), s))
    found, hit = "_ids", "_hit"
    while found in docs.columns or hit in docs.columns:
        found, hit = found + "_", hit + "_"
    mine = ("sentence_ids", "licenses", "unmatched")
    out = docs.withColumn(found, F.concat(F.lit(","), F.array_join(ids, ","), F.lit(",")))
    return out.withColumn(hit, _apply_rules(F.col(found), rules)).select(
        *(F.col(f"`{c}`") for c in docs.columns if c not in mine),
        F.trim(F.col(found), F.lit(",")).alias("sentence_ids"),
        F.col(f"{hit}.licenses").alias("licenses"),
        F.col(f"{hit}.rest").alias("unmatched"),
    )


def _run(rule: Sequence[str]) -> str:
    """A rule's identifiers as they stand in a sequence; identifiers hold no comma or semicolon."""
    return "," + ",,".join(rule) + ","


def _apply_rules(ids: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Fold the ordered rules over the identifier string; texts without identifiers skip the fold."""
    # every identifier has two commas of its own, so runs lie side by side; a consumed run leaves a
    # mark, so what stood on either side of it never becomes neighbours
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(_run(r)).alias("r")) for n, r in rules])
    start = F.struct(F.replace(ids, F.lit(","), F.lit(",,")).alias("rest"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, rule: Column) -> Column:
        found = F.contains(acc["rest"], rule["r"])
        return F.struct(
            F.when(found, F.replace(acc["rest"], rule["r"], F.lit(";"))).otherwise(acc["rest"]).alias("rest"),
            F.when(found & ~F.array_contains(acc["names"], rule["n"]), F.array_append(acc["names"], rule["n"]))
            .otherwise(acc["names"])
            .alias("names"),
        )

    def finish(acc: Column) -> Column:
        return F.struct(
            F.array_join(acc["names"], ",").alias("licenses"),
            F.trim(F.regexp_replace(acc["rest"], "[,;]+", ","), F.lit(",")).alias("rest"),
        )

    none = F.struct(F.lit("").alias("licenses"), F.lit("").alias("rest"))
    return F.when(ids == ",,", none).otherwise(F.aggregate(table, start, step, finish))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its licence sentence identifiers and the licences they prove."""
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    return recognise(docs).select("doc_id", "sentence_ids", "licenses", "unmatched")


def oracle() -> str:
    """The same result in DuckDB SQL: joins stand for the look-ups, nested REPLACE calls for the fold over rules."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(s)}, {q(i)})" for s, i in KNOWN.items())
    steps = []
    for n, (name, rule) in enumerate(RULES):
        steps.append(
            f"s{n + 1} AS (SELECT *, contains(r{n}, {q(_run(rule))}) AS h{n}, "
            f"replace(r{n}, {q(_run(rule))}, ';') AS r{n + 1} FROM s{n})"
        )
    names = ", ".join(f"CASE WHEN h{n} THEN {q(name)} END" for n, (name, _) in enumerate(RULES))
    last = len(RULES)
    return rf"""
WITH known(s, i) AS (VALUES {known}),
folded AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '\r\n?', chr(10), 'g') AS t FROM documents),
cut AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '{BREAK}', chr(2), 'g'), '[^a-z0-9\n\x02]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS t FROM folded),
parts AS (SELECT doc_id, generate_subscripts(p, 1) AS k, trim(unnest(p), ' ' || chr(10)) AS p FROM (SELECT doc_id, string_split(t, chr(2)) AS p FROM cut)),
forms AS (
  SELECT doc_id, k, p, trim(replace(p, chr(10), ' ')) AS a, instr(p, chr(10)) AS n,
         trim(replace(substr(p, instr(p, chr(10)) + 1), chr(10), ' ')) AS b, trim(substr(p, 1, greatest(instr(p, chr(10)) - 1, 0))) AS f
  FROM parts WHERE length(p) >= {min(map(len, KNOWN))}
),
way AS (SELECT *, CASE WHEN a IN (SELECT s FROM known) THEN 1 WHEN n = 0 THEN 0 WHEN b IN (SELECT s FROM known) THEN 2 ELSE 3 END AS w FROM forms),
said AS (
  SELECT doc_id, k, 1 AS j, a AS s FROM way WHERE w = 1
  UNION ALL SELECT doc_id, k, 1, f FROM way WHERE w = 2
  UNION ALL SELECT doc_id, k, 2, b FROM way WHERE w = 2
  UNION ALL SELECT doc_id, k, generate_subscripts(l, 1), trim(unnest(l)) FROM (SELECT doc_id, k, string_split(p, chr(10)) AS l FROM way WHERE w = 3)
),
ids AS (SELECT doc_id, string_agg(i, ',' ORDER BY k, j) AS sentence_ids FROM said JOIN known USING (s) GROUP BY doc_id),
s0 AS (
  SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids,
         ',,' || replace(coalesce(sentence_ids, ''), ',', ',,') || ',,' AS r0
  FROM documents LEFT JOIN ids USING (doc_id)
),
{", ".join(steps)}
SELECT doc_id, sentence_ids,
       array_to_string(list_filter(list_distinct_ordered, lambda x: x IS NOT NULL), ',') AS licenses,
       trim(regexp_replace(r{last}, '[,;]+', ',', 'g'), ',') AS unmatched
FROM (SELECT *, list_reduce(list_transform([{names}], lambda x: [x]),
        lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_ordered
      FROM s{last})
"""
