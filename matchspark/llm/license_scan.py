"""License scans by sentence-rule recognition, with DataFrame functions only.

A text is cut into sentences (at ``. `` and between paragraphs; a line end within
a paragraph may end a sentence or wrap it, the longest known sentence counts).
Each is normalised (lower case, ``licence`` spelt ``license``, ``v. 2`` and ``v2``
to ``version 2``, anything else but letters and digits to one space), and looked
up among the known licence sentences of ``SENTENCES`` and ``FULL_SENTENCES``. A rule of ``FULL_RULES`` and ``RULES`` is an ordered sequence
of sentence identifiers; it holds where its identifiers stand in the text in
that order with no other licence sentence between them. Rules are tried from
the longest, so a longer rule takes its sentences from a shorter one. References to licences by name, Creative Commons' sentences and SPDX tags
are built by rule. The SQL knows sentences of one line.

The result has one row for each document with a licence sentence: the sentence
identifiers in order, the licences of the rules that hold, the identifiers that
no rule explains, and a verdict: ``none`` (sentences without a rule), ``one`` or
``several``.

Defined results. Null or empty text, or one without licence sentences: no row.
A sentence that stands twice counts twice; a licence that holds twice is named
once. doc_id may be null or repeat; rows are judged one by one. Further columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm._tables import table

#: Normalised sentence to identifier.
SENTENCES = {
    "released under the mit license": "MITref",
    "licensed under the mit license": "MITref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is without warranty of any kind express or implied": "AsIs",
    "licensed under the apache license version 2 0": "Apache2ref",
    "you may not use this file except in compliance with the license": "Apache2comply",
    "you may obtain a copy of the license at": "Apache2obtain",
    "this work is licensed under the gnu general public license version 3": "GPL3ref",
    "this work is licensed under the gnu general public license version 2": "GPL2ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "GPLgrant",
    "either version 3 of the license or at your option any later version": "GPL3later",
    "either version 2 of the license or at your option any later version": "GPL2later",
    "this work is licensed under the gnu lesser general public license version 3": "LGPL3ref",
    "licensed under cc by nc 4 0": "CCBYNC4ref",
    "licensed under cc by 4 0": "CCBY4ref",
    "licensed under cc by sa 4 0": "CCBYSA4ref",
    "redistribution and use in source and binary forms with or without modification are permitted": "BSDgrant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "BSDendorse",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2ref",
    "this is free and unencumbered software released into the public domain": "PublicDomain",
    "all rights reserved": "AllRights",
}
#: Ordered rules, and the licence that each names. Longer rules come first.
RULES = [
    ("MITgrant,MITnotice,AsIs", "MIT"),
    ("Apache2ref,Apache2comply,Apache2obtain", "Apache-2.0"),
    ("GPLgrant,GPL3later", "GPL-3.0-or-later"),
    ("GPLgrant,GPL2later", "GPL-2.0-or-later"),
    ("BSDgrant,BSDendorse", "BSD-3-Clause"),
    ("MITgrant,MITnotice", "MIT"),
    ("MITref", "MIT"),
    ("Apache2ref", "Apache-2.0"),
    ("GPL3ref", "GPL-3.0-only"),
    ("GPL2ref", "GPL-2.0-only"),
    ("LGPL3ref", "LGPL-3.0-only"),
    ("CCBYNC4ref", "CC-BY-NC-4.0"),
    ("CCBY4ref", "CC-BY-4.0"),
    ("CCBYSA4ref", "CC-BY-SA-4.0"),
    ("BSDgrant", "BSD-2-Clause"),
    ("MPL2ref", "MPL-2.0"),
    ("PublicDomain", "Unlicense"),
]
#: Sentences of the standard notices in full, to identifier.
FULL_SENTENCES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions": "MITgrant",
    "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": "AsIs",
    "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software": "MITliable",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License": "Apache2head",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "Apache2obtain",
    "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0": "Apache2obtain",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied": "Apache2asis",
    "See the License for the specific language governing permissions and limitations under the License": "Apache2see",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "GPL3grant",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version": "GPL2grant",
    "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose": "GPLwarranty",
    "See the GNU General Public License for more details": "GPLsee",
    "You should have received a copy of the GNU General Public License along with this program": "GPLcopy",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BSDgrant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BSDsource",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BSDbinary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDasis",
    "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage": "BSDliable",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0": "MPL2copy",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0": "MPL2copy",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "0BSDgrant",
    "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCasis",
    "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software": "ISCliable",
    "This software is provided as-is, without any express or implied warranty": "ZlibAsIs",
    "In no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiable",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions": "ZlibGrant",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software": "ZlibOrigin",
    "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required": "ZlibThanks",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software": "ZlibAltered",
    "This notice may not be removed or altered from any source distribution": "ZlibNotice",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following": "BoostGrant",
    "Distributed under the Boost Software License, Version 1.0": "Boostref",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means": "UnlicenseGrant",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain": "UnlicenseDedicate",
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors": "UnlicenseBenefit",
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law": "UnlicenseIntend",
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0dedicate",
    "This software is distributed without any warranty": "CC0warranty",
    "You should have received a copy of the CC0 Public Domain Dedication along with this software": "CC0copy",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version": "LGPL21grant",
    "This library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose": "LGPLwarranty",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "LGPL3grant",
    "See the GNU Lesser General Public License for more details": "LGPLsee",
    "You should have received a copy of the GNU Lesser General Public License along with this library": "LGPLcopy",
    "You should have received a copy of the GNU Lesser General Public License along with this program": "LGPLcopy",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "AGPL3grant",
    "See the GNU Affero General Public License for more details": "AGPLsee",
    "You should have received a copy of the GNU Affero General Public License along with this program": "AGPLcopy",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0": "EPL2grant",
    "This Source Code may also be made available under the following Secondary Licenses when the conditions for such availability set forth in the Eclipse Public License, v. 2.0 are satisfied": "EPL2secondary",
    "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements": "ASFlicensed",
    "See the NOTICE file distributed with this work for additional information regarding copyright ownership": "ASFnotice",
    "The ASF licenses this file to You under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License": "ASFhead",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement": "BSDadvert",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed": "WTFPLcopy",
    "See the LICENSE file for details": "SeeFile",
    "See LICENSE for details": "SeeFile",
}
#: Names of licences as references to them give them, by identifier.
NAMES = {
    "MIT": ("MIT License",), "ISC": ("ISC License",), "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"), "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"), "GPL-2.0-only": ("GNU General Public License v2.0",), "GPL-3.0-only": ("GNU General Public License v3.0",), "LGPL-3.0-only": ("GNU Lesser General Public License v3.0",),
    "AGPL-3.0-only": ("GNU Affero General Public License v3.0",), "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"), "EPL-2.0": ("Eclipse Public License 2.0",), "BSL-1.0": ("Boost Software License 1.0",),
    "Unlicense": ("Unlicense",), "Zlib": ("zlib License",), "CC0-1.0": ("CC0 1.0 Universal License",),
}
#: What stands before the name in a reference.
OPENINGS = ("Licensed under the", "Released under the", "Distributed under the", "Available under the", "This project is licensed under the", "This software is licensed under the", "This file is licensed under the")
#: Kinds and versions of the Creative Commons licences.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
COMMONS_VERSIONS = {"4.0": "4.0 International", "3.0": "3.0 Unported"}
#: Identifiers that a tag may name beyond those of NAMES.
TAGGED = ("GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "0BSD", "WTFPL", "EPL-1.0", "Apache-1.1", "MIT-0", "CC-BY-4.0", "CC-BY-SA-4.0")


def _references() -> dict[str, tuple[str, str]]:
    """Sentences that name a licence: (sentence identifier, licence)."""
    found = {f"{opening} {name}": (f"ref {licence}", licence) for licence, names in NAMES.items() for name in names for opening in OPENINGS}
    for kind, words in COMMONS.items():
        for version, edition in COMMONS_VERSIONS.items():
            for article in ("a", "the"):
                found[f"This work is licensed under {article} Creative Commons {words} {edition} License"] = (f"ref CC-{kind}-{version}", f"CC-{kind}-{version}")
    return found | {f"SPDX-License-Identifier: {licence}": (f"tag {licence}", licence) for licence in (*NAMES, *TAGGED)}


#: Rules of the standard notices, tried before ``RULES``. Longer rules come first.
FULL_RULES = [
    ("ZlibAsIs,ZlibLiable,ZlibGrant,ZlibOrigin,ZlibThanks,ZlibAltered,ZlibNotice", "Zlib"),
    ("BSDgrant,BSDsource,BSDbinary,BSDadvert,BSDendorse,BSDasis,BSDliable", "BSD-4-Clause"),
    ("ASFlicensed,ASFnotice,ASFhead,Apache2obtain,Apache2asis,Apache2see", "Apache-2.0"),
    ("PublicDomain,UnlicenseGrant,UnlicenseDedicate,UnlicenseBenefit,UnlicenseIntend,AsIs", "Unlicense"),
    ("BSDgrant,BSDsource,BSDbinary,BSDendorse,BSDasis,BSDliable", "BSD-3-Clause"),
    ("BSDgrant,BSDsource,BSDbinary,BSDasis,BSDliable", "BSD-2-Clause"),
    ("BSDgrant,BSDsource,BSDbinary,BSDendorse", "BSD-3-Clause"),
    ("MITgrant,MITnotice,AsIs,MITliable", "MIT"),
    ("Apache2head,Apache2obtain,Apache2asis,Apache2see", "Apache-2.0"),
    ("LGPL21grant,LGPLwarranty,LGPLsee,LGPLcopy", "LGPL-2.1-or-later"),
    ("LGPL3grant,GPLwarranty,LGPLsee,LGPLcopy", "LGPL-3.0-or-later"),
    ("AGPL3grant,GPLwarranty,AGPLsee,AGPLcopy", "AGPL-3.0-or-later"),
    ("GPL3grant,GPLwarranty,GPLsee,GPLcopy", "GPL-3.0-or-later"),
    ("GPL2grant,GPLwarranty,GPLsee,GPLcopy", "GPL-2.0-or-later"),
    ("ISCgrant,ISCasis,ISCliable", "ISC"),
    ("0BSDgrant,ISCasis,ISCliable", "0BSD"),
    ("CC0dedicate,CC0warranty,CC0copy", "CC0-1.0"),
    ("ZlibAsIs,ZlibLiable,ZlibGrant", "Zlib"),
    ("BSDgrant,BSDsource,BSDbinary", "BSD-2-Clause"),
    ("PublicDomain,UnlicenseGrant", "Unlicense"),
    ("EPL2grant,EPL2secondary", "EPL-2.0"),
    ("Apache2head,Apache2obtain", "Apache-2.0"),
    ("MPL2ref,MPL2copy", "MPL-2.0"),
    ("Apache2head", "Apache-2.0"),
    ("ASFhead", "Apache-2.0"),
    ("ISCgrant", "ISC"),
    ("0BSDgrant", "0BSD"),
    ("BoostGrant", "BSL-1.0"),
    ("Boostref", "BSL-1.0"),
    ("CC0dedicate", "CC0-1.0"),
    ("LGPL21grant", "LGPL-2.1-or-later"),
    ("LGPL3grant", "LGPL-3.0-or-later"),
    ("AGPL3grant", "AGPL-3.0-or-later"),
    ("EPL2grant", "EPL-2.0"),
    ("WTFPLcopy", "WTFPL"),
    ("GPL3grant", "GPL-3.0-or-later"),
    ("GPL2grant", "GPL-2.0-or-later"),
]
#: A sentence without any of these is none of a licence; checked before it is normalised.
HINT = r"(?i)licen[sc]e|licens|permission|redistribut|warrant|copyright|rights reserved|public domain|this program is free|version [23] of|endorse|free to copy|liable|misrepresented|this software|source distribution|dedication|distributed with"
#: Ends of sentences, for the SQL.
BREAK = r"\n|\. "


#: What normalises a text, in order: ``|`` then stands for the end of a sentence or paragraph, ``/`` for any other line end.
STEPS = [
    ("licence", "license"), (r"[|/]", " "), (r"\b(?:version|ver\.?|v\.?)\s*(?=[0-9])", "version "),
    (r"\.\s|\n[^a-z0-9]*\n", "|"), (r"\n", "/"), (r"[^a-z0-9|/]+", " "), (r" ?([|/]) ?", r"$1"),
]


def _known() -> dict[str, str]:
    """Identifiers by normalised sentence."""
    fold = lambda x: re.sub(r"\bv(?:ersion)? ?(?=[0-9])", "version ", re.sub("[^a-z0-9]+", " ", x.lower()).strip())
    found = {fold(x): i for x, (i, _) in _references().items()}
    return found | {fold(x): i for x, i in [*FULL_SENTENCES.items(), *SENTENCES.items()]}


def _rules() -> tuple[list[tuple[str, str]], dict[str, str]]:
    """The rules of several sentences, in the order in which they are tried, and then the licence by single sentence."""
    every = FULL_RULES + RULES
    return [(rule, name) for rule, name in every if "," in rule], {rule: name for rule, name in [*every, *_references().values()] if "," not in rule}


def known_sentences(text: Column) -> Column:
    """Identifiers of the licence sentences of a text, in order."""
    known = _known()
    marked = F.lower(text)
    for pattern, to in STEPS:
        marked = F.regexp_replace(marked, pattern, to)
    marked = F.concat(F.lit("|"), F.trim(marked), F.lit("|"))
    any_of = "|".join(x.replace(" ", "[ /]") for x in sorted(known, key=len, reverse=True))
    ids = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.transform(F.regexp_extract_all(marked, F.lit(f"(?<=[|/])(?:{any_of})(?=[|/])"), F.lit(0)), lambda x: F.try_element_at(ids, F.translate(x, "/", " ")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses (both joined by commas), n_unexplained, verdict."""
    rows = docs.where(F.col("text").rlike(HINT)).select("doc_id", known_sentences(F.col("text")).alias("ids")).where(F.size("ids") > 0)
    out = rows.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.transform("ids", lambda x: F.concat(F.lit(","), x, F.lit(","))), "").alias("_left"), F.array().cast("array<string>").alias("_found"))
    several, single = _rules()
    for rule, name in several:
        mark = "," + ",,".join(rule.split(",")) + ","
        out = out.select("doc_id", "sentence_ids", F.replace("_left", F.lit(mark), F.lit(";")).alias("_new"), "_left", "_found").select(
            "doc_id", "sentence_ids", F.col("_new").alias("_left"), F.when(F.col("_new") != F.col("_left"), F.array_append("_found", F.lit(name))).otherwise(F.col("_found")).alias("_found")
        )
    names = F.create_map(*(F.lit(x) for pair in single.items() for x in pair))
    rest = F.filter(F.split("_left", "[,;]+"), lambda x: x != "")
    out = out.select("doc_id", "sentence_ids", "_found", F.transform(rest, lambda x: F.try_element_at(names, x)).alias("_single"))
    named = F.array_sort(F.array_distinct(F.concat("_found", F.array_compact("_single"))))
    return out.select(
        "doc_id", "sentence_ids", F.array_join(named, ",").alias("licenses"), F.size(F.filter("_single", lambda x: x.isNull())).cast("long").alias("n_unexplained"),
        F.when(F.size(named) == 0, "none").when(F.size(named) == 1, "one").otherwise("several").alias("verdict"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    sentences = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in _known().items())
    several, single = _rules()
    steps, found, at = [], [], "l_"
    for i, (rule, name) in enumerate(several):
        mark = quote("," + ",,".join(rule.split(",")) + ",")
        steps.append(f"s{i} AS (SELECT *, replace({at}, {mark}, ';') AS l{i} FROM {'seqs' if not i else f's{i - 1}'})")
        found.append(f"CASE WHEN l{i} <> {at} THEN {quote(name)} END")
        at = f"l{i}"
    cases = " ".join(f"WHEN {quote(a)} THEN {quote(b)}" for a, b in single.items())
    return f"""
WITH known(sentence, id) AS (VALUES {sentences}),
parts AS (SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(text, {quote(BREAK)}) AS p FROM documents WHERE regexp_matches(text, {quote(HINT)})),
pieces AS (SELECT r, doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS pos FROM parts),
hits AS (SELECT r, doc_id, pos, id FROM (SELECT * FROM pieces WHERE regexp_matches(s, {quote(HINT)})) JOIN known ON sentence = trim(regexp_replace(replace(lower(s), 'licence', 'license'), '[^a-z0-9]+', ' ', 'g'))),
listed AS (SELECT r, doc_id, list(id ORDER BY pos) AS ids FROM hits GROUP BY r, doc_id),
seqs AS (SELECT *, list_aggregate(list_transform(ids, lambda x: ',' || x || ','), 'string_agg', '') AS l_ FROM listed),
{", ".join(steps)},
rest AS (SELECT *, list_transform(list_filter(regexp_split_to_array({at}, '[,;]+'), lambda x: x <> ''), lambda x: CASE x {cases} END) AS single FROM s{len(several) - 1}),
named AS (SELECT *, list_sort(list_distinct(list_filter(list_concat([{", ".join(found)}], single), lambda x: x IS NOT NULL))) AS names FROM rest)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(names, ',') AS licenses,
       CAST(len(list_filter(single, lambda x: x IS NULL)) AS BIGINT) AS n_unexplained,
       CASE WHEN len(names) = 0 THEN 'none' WHEN len(names) = 1 THEN 'one' ELSE 'several' END AS verdict
FROM named"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE_SQL = {"op1_license_scan": _sql()}
