"""Operator 2: licence scans by sentences and ordered rules, in DataFrame functions only.

A text is cut into sentences; each is normalised and looked up in a table of known licence sentences, which gives a
sequence of sentence identifiers. Licence rules are sequences of identifiers; the rules are tried in their order, and a
rule that matches takes its sentences out of the sequence, so that a later, more general rule can't claim them again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence sentences -> identifier. They are compared in normalised form (`plain`), so case, signs and line breaks don't matter.
TEXTS = (
    ("Licensed under the Apache License, Version 2.0", "ApacheLic2"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "ApacheLic2Use"),
    ("You may not use this file except in compliance with the License", "ApacheUse"),
    ("You may obtain a copy of the License at", "ApacheCopy"),
    ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "ApacheCopy"),
    ("You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "ApacheCopy"),
    ("http://www.apache.org/licenses/LICENSE-2.0", "ApacheAddress"),
    ("https://www.apache.org/licenses/LICENSE-2.0", "ApacheAddress"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "ApacheAsIs"),
    ("See the License for the specific language governing permissions and limitations under the License", "ApacheSee"),
    ("Released under the MIT License", "MITName"),
    ("Licensed under the MIT License", "MITName"),
    ("This software is released under the MIT License", "MITName"),
    ("This project is licensed under the MIT License", "MITName"),
    ("SPDX-License-Identifier: MIT", "MITName"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "MITGrant"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "MITNotice"),
    ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT", "MITWarranty"),
    ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE", "MITLiability"),
    ("This work is licensed under the GNU General Public License, version 3", "GPLv3"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "GPLv3+"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "GPLv2+"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "GPLv2"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation", "GPLv3"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "LGPLv2.1+"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "LGPLv3+"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "AGPLv3+"),
    ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE", "GNUWarranty"),
    ("See the GNU General Public License for more details", "GNUSee"),
    ("See the GNU Lesser General Public License for more details", "GNUSee"),
    ("See the GNU Affero General Public License for more details", "GNUSee"),
    ("SPDX-License-Identifier: GPL-2.0-only", "GPLv2"),
    ("SPDX-License-Identifier: GPL-2.0", "GPLv2"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPLv2+"),
    ("SPDX-License-Identifier: GPL-3.0-only", "GPLv3"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "GPLv3+"),
    ("SPDX-License-Identifier: Apache-2.0", "ApacheLic2"),
    ("SPDX-License-Identifier: MPL-2.0", "MPLv2"),
    ("SPDX-License-Identifier: BSD-2-Clause", "BSD2Name"),
    ("SPDX-License-Identifier: BSD-3-Clause", "BSD3Name"),
    ("SPDX-License-Identifier: ISC", "ISCName"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "BSDGrant"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "BSDSource"),
    ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "BSDBinary"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "BSDEndorse"),
    ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED", "BSDWarranty"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v 2.0", "MPLv2"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "MPLCopy"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "MPLCopy"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "ISCGrant"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "ISCGrant"),
    ("THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS", "ISCWarranty"),
    ("Licensed under CC BY-NC 4.0", "CCBYNC4"),
    ("Licensed under CC BY 4.0", "CCBY4"),
    ("Licensed under CC BY-SA 4.0", "CCBYSA4"),
    ("This work is dedicated to the public domain under CC0 1.0", "CC0"),
    ("This is free and unencumbered software released into the public domain", "Unlicense"),
    ("SPDX-License-Identifier: GPL-3.0", "GPLv3"),
    ("SPDX-License-Identifier: LGPL-2.1-only", "LGPLv2.1"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPLv2.1+"),
    ("SPDX-License-Identifier: LGPL-3.0-only", "LGPLv3"),
    ("SPDX-License-Identifier: LGPL-3.0-or-later", "LGPLv3+"),
    ("SPDX-License-Identifier: AGPL-3.0-only", "AGPLv3"),
    ("SPDX-License-Identifier: AGPL-3.0-or-later", "AGPLv3+"),
    ("SPDX-License-Identifier: CC-BY-4.0", "CCBY4"),
    ("SPDX-License-Identifier: CC-BY-SA-4.0", "CCBYSA4"),
    ("SPDX-License-Identifier: CC-BY-NC-4.0", "CCBYNC4"),
    ("SPDX-License-Identifier: CC0-1.0", "CC0"),
    ("SPDX-License-Identifier: Unlicense", "Unlicense"),
    ("SPDX-License-Identifier: BSL-1.0", "BSL1"),
    ("SPDX-License-Identifier: Zlib", "Zlib"),
    ("SPDX-License-Identifier: EPL-2.0", "EPLv2"),
    ("License: MIT", "MITName"),
    ("License: Apache-2.0", "ApacheLic2"),
    ("License: BSD-3-Clause", "BSD3Name"),
    ("License: MPL-2.0", "MPLv2"),
    ("Licensed under the Apache License 2.0", "ApacheLic2"),
    ("This project is licensed under the Apache License 2.0", "ApacheLic2"),
    ("This project is licensed under the Apache License, Version 2.0", "ApacheLic2"),
    ("This project is licensed under the MIT License - see the LICENSE file for details", "MITName"),
    ("This project is licensed under the MIT License - see the LICENSE.md file for details", "MITName"),
    ("Distributed under the Boost Software License, Version 1.0", "BSL1"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "EPLv2"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "EPLv2"),
    ("Licensed under a Creative Commons Attribution 4.0 International License", "CCBY4"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "CCBY4"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "CCBYSA4"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "CCBYNC4"),
)

#: What may vary in a normalised sentence -> how it stands in the table.
FIELDS = (
    ("\\bthis (library|software|file|package|module) is (free software|distributed in the hope)", "this program is $2"),
    ("conditions are met [0-9a]$", "conditions are met"),
    ("^neither the names? of .+? nor the names of (its|their|any|the) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    ("^this software is provided by .+? as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
)


def plain(sentence: str) -> str:
    """A sentence in normalised form: lower-cased ASCII letters and digits, every run of anything else one space."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


SENTENCES = {plain(s): i for s, i in TEXTS}


@dataclass(frozen=True)
class LicenceRule:
    """A licence, and the sentence identifiers that must stand one after another in the sequence."""

    licence: str
    sequence: tuple[str, ...]


#: The rules in the order in which they are tried, longer ones before the ones they contain.
RULES = (
    LicenceRule("Apache-2.0", ("ApacheLic2Use", "ApacheCopy", "ApacheAddress", "ApacheAsIs", "ApacheSee")),
    LicenceRule("Apache-2.0", ("ApacheLic2Use", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    LicenceRule("Apache-2.0", ("ApacheLic2Use", "ApacheCopy")),
    LicenceRule("Apache-2.0", ("ApacheLic2Use",)),
    LicenceRule("Apache-2.0", ("ApacheLic2", "ApacheUse", "ApacheCopy")),
    LicenceRule("MIT", ("MITGrant", "MITNotice", "MITWarranty", "MITLiability")),
    LicenceRule("MIT", ("MITGrant", "MITNotice", "MITWarranty")),
    LicenceRule("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDWarranty")),
    LicenceRule("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse")),
    LicenceRule("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDWarranty")),
    LicenceRule("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary")),
    LicenceRule("AGPL-3.0-or-later", ("AGPLv3+", "GNUWarranty", "GNUSee")),
    LicenceRule("AGPL-3.0-or-later", ("AGPLv3+",)),
    LicenceRule("LGPL-3.0-or-later", ("LGPLv3+", "GNUWarranty", "GNUSee")),
    LicenceRule("LGPL-3.0-or-later", ("LGPLv3+",)),
    LicenceRule("LGPL-2.1-or-later", ("LGPLv2.1+", "GNUWarranty", "GNUSee")),
    LicenceRule("LGPL-2.1-or-later", ("LGPLv2.1+",)),
    LicenceRule("GPL-3.0-or-later", ("GPLv3+", "GNUWarranty", "GNUSee")),
    LicenceRule("GPL-3.0-or-later", ("GPLv3+",)),
    LicenceRule("GPL-2.0-or-later", ("GPLv2+", "GNUWarranty", "GNUSee")),
    LicenceRule("GPL-2.0-or-later", ("GPLv2+",)),
    LicenceRule("GPL-2.0-only", ("GPLv2", "GNUWarranty", "GNUSee")),
    LicenceRule("GPL-2.0-only", ("GPLv2",)),
    LicenceRule("GPL-3.0-only", ("GPLv3", "GNUWarranty", "GNUSee")),
    LicenceRule("GPL-3.0-only", ("GPLv3",)),
    LicenceRule("MPL-2.0", ("MPLv2", "MPLCopy")),
    LicenceRule("MPL-2.0", ("MPLv2",)),
    LicenceRule("ISC", ("ISCGrant", "ISCWarranty")),
    LicenceRule("ISC", ("ISCGrant",)),
    LicenceRule("ISC", ("ISCName",)),
    LicenceRule("Apache-2.0", ("ApacheLic2",)),
    LicenceRule("MIT", ("MITName",)),
    LicenceRule("BSD-2-Clause", ("BSD2Name",)),
    LicenceRule("BSD-3-Clause", ("BSD3Name",)),
    LicenceRule("CC-BY-NC-4.0", ("CCBYNC4",)),
    LicenceRule("CC-BY-SA-4.0", ("CCBYSA4",)),
    LicenceRule("CC-BY-4.0", ("CCBY4",)),
    LicenceRule("CC0-1.0", ("CC0",)),
    LicenceRule("Unlicense", ("Unlicense",)),
    LicenceRule("LGPL-2.1-only", ("LGPLv2.1",)),
    LicenceRule("LGPL-3.0-only", ("LGPLv3",)),
    LicenceRule("AGPL-3.0-only", ("AGPLv3",)),
    LicenceRule("BSL-1.0", ("BSL1",)),
    LicenceRule("Zlib", ("Zlib",)),
    LicenceRule("EPL-2.0", ("EPLv2",)),
)

#: Fixed value: words of which every sentence of TEXTS has one, so that other sentences needn't be normalised.
ANCHOR = r"(?i)licen|permi|copyright|warrant|redistribut|public\s+domain|no\s+event|mozilla"
#: Fixed values: `v. 2` is no sentence end; a sentence ends at `.`, `!` or `?` before white space, or at a line without letters and digits.
ABBREVIATED = r"(?i)\bv\.[ \t]+([0-9])"
SENTENCE_END = r"[.!?]+[\"')\]]*(?:\s+|$)|\n[ \t\r\n/*#;%!<>|-]*\n"


def openings(known: dict[str, str] = SENTENCES, words: int = 10) -> list[str]:
    """How the long known sentences begin, in as few words (4 at least) as stand within no other known sentence.

    A sentence begins there too: titles and list items without a sign between are cut off from it.
    """
    out = set()
    for s in known:
        own = s.split(" ")
        if len(own) >= words:
            for n in range(4, len(own) + 1):
                head = " ".join(own[:n])
                if not any(f" {head} " in f"{other} " for other in known):
                    out.add(head)
                    break
    return sorted(out, key=lambda h: (-len(h), h))


def normalised(sentence: Column) -> Column:
    """Lower-cased ASCII letters and digits, every run of anything else one space, none at the ends; then FIELDS."""
    out = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    for pattern, instead in FIELDS:
        out = F.regexp_replace(out, pattern, instead)
    return out


def identifiers(text: Column, known: dict[str, str] = SENTENCES, anchor: str | None = None) -> Column:
    """The identifiers of the text's known sentences, in order. A sentence must stand whole.

    Line breaks and comment signs in a sentence don't matter. Where none of what lies between two sentence ends is known, its lines
    are looked up one by one, as of titles and tags without a full stop. Pieces without `anchor` are left out; by default
    that of the own table, and with another table of sentences none are.
    """
    anchor = anchor if anchor is not None else ANCHOR if known is SENTENCES else ""
    names, ids = F.array(*[F.lit(s) for s in known]), F.array(*[F.lit(i) for i in known.values()])
    opening = " (" + "|".join(openings(known)) + r")\b"

    def found(sentences: Column) -> Column:
        places = F.filter(F.transform(sentences, lambda s: F.array_position(names, s)), lambda p: p > 0)
        return F.transform(places, lambda p: F.element_at(ids, p.cast("int")))

    def cut(piece: Column) -> Column:
        whole = normalised(piece)
        return F.split(F.regexp_replace(whole, opening, "\n$1"), "\n") if openings(known) else F.array(whole)

    def told(piece: Column) -> Column:
        own = found(cut(piece))
        lines = F.filter(F.split(piece, "\n"), lambda line: line.rlike(anchor))
        return F.when(F.size(own) > 0, own).otherwise(found(F.transform(lines, normalised)))

    body = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), ABBREVIATED, "v $1")
    pieces = F.filter(F.split(body, SENTENCE_END), lambda p: p.rlike(anchor))
    return F.flatten(F.transform(pieces, told))


def apply_rules(sequence: str, rules: tuple[LicenceRule, ...] = RULES) -> Column:
    """struct(licences, rest): the distinct licences in the rules' order, and the identifiers that no rule has taken.

    The sequence is spelled as `,A,,B,`; a rule's spelling is taken out wherever it stands, left to right, and leaves a bar.
    """
    start = F.struct(
        F.array_join(F.transform(sequence, lambda i: F.concat(F.lit(","), i, F.lit(","))), "").alias("left"),
        F.array().cast("array<string>").alias("licences"),
    )

    table = F.array(*[F.struct(F.lit("," + ",,".join(r.sequence) + ",").alias("spelled"), F.lit(r.licence).alias("licence")) for r in rules])
    state = F.aggregate(
        table,
        start,
        lambda s, r: F.struct(
            F.replace(s["left"], r["spelled"], F.lit(",|,")).alias("left"),
            F.when(F.contains(s["left"], r["spelled"]), F.array_union(s["licences"], F.array(r["licence"]))).otherwise(s["licences"]).alias("licences"),
        ),
    )
    rest = F.filter(F.split(state["left"], "[,|]+"), lambda i: i != "")
    return F.struct(state["licences"].alias("licences"), rest.alias("rest"))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_sentences (known ones), sequence, licences, unmatched (each a comma-joined string).

    Null, empty and unlicensed texts have 0 and empty strings. Rows are independent: nothing is shuffled, so hot keys, copies
    and clashing columns don't matter.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), identifiers(F.col(text_col)).alias("ids"))
    rows = rows.select("doc_id", "ids", F.when(F.size("ids") > 0, apply_rules("ids")).alias("found"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sequence"),
        F.coalesce(F.array_join("found.licences", ","), F.lit("")).alias("licences"),
        F.coalesce(F.array_join("found.rest", ","), F.lit("")).alias("unmatched"),
    )
