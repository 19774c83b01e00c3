"""Licence scans by sentence rules, in Spark expressions.

A text is normalised (lower case, letters and digits parted by single blanks, with marks for lines and sentence ends) and
searched for a table of known licence sentences, wrapped or not; the identifiers found, in text order, are matched against ordered rules: a
rule holds if its identifiers occur as a run in the sequence, and takes them, so that a shorter rule doesn't find them again. Other sentences
between known ones have no identifier and don't break a run. All licences whose rules hold are returned, the longest rule's first.

Defined cases: a null or empty text has no sentence and gives no row; a sentence that occurs again counts again in
``identifiers``, once in ``licenses``; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices as published, and their identifiers.
PUBLISHED = [
    ("mit-title", "The MIT License"),
    ("mit-title", "MIT License"),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Licensed under the MIT License."),
    ("mit-notice", "This project is licensed under the MIT License."),
    ("mit-notice", "SPDX-License-Identifier: MIT"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-warranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("mit-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-title", "ISC License"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-warranty", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-advertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("bsd-name", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-name", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-warranty", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("apache-title", "Apache License Version 2.0, January 2004"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-notice", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("apache-notice", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-compliance", "you may not use this file except in compliance with the License."),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-warranty", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache-limits", "See the License for the specific language governing permissions and limitations under the License."),
    ("apache-terms", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("gpl3-title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl2-title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl3-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl2-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl3-notice", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl2-notice", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl3-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl2-grant", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl3-only-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("gpl2-only-grant", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-details", "See the GNU General Public License for more details."),
    ("gpl-copy", "You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl21-grant", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl3-grant", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-warranty", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("agpl3-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("fsf-verbatim", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("mpl2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("bsl-notice", "Distributed under the Boost Software License, Version 1.0."),
    ("bsl-title", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("zlib-warranty", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("unlicense-grant", "This is free and unencumbered software released into the public domain."),
    ("cc0-grant", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("cc-by-notice", "Licensed under CC BY 4.0."),
    ("cc-by-sa-notice", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd-notice", "Licensed under CC BY-ND 4.0."),
    ("cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd-notice", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
]

# Rules in order; a longer rule stands before those that it contains.
RULES = [
    ("Apache-2.0", ["apache-notice", "apache-compliance", "apache-copy", "apache-warranty", "apache-limits"]),
    ("Apache-2.0", ["apache-notice", "apache-compliance", "apache-copy", "apache-warranty"]),
    ("MIT", ["mit-title", "mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-name"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-title", "mit-grant", "mit-condition"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("0BSD", ["0bsd-grant", "isc-warranty"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("MPL-2.0", ["mpl2-notice", "mpl2-copy"]),
    ("Apache-2.0", ["apache-title", "apache-terms"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-warranty", "gpl-details", "gpl-copy"]),
    ("GPL-2.0-or-later", ["gpl2-grant", "gpl-warranty", "gpl-details", "gpl-copy"]),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-grant", "gpl-warranty"]),
    ("GPL-3.0-only", ["gpl3-only-grant", "gpl-warranty"]),
    ("GPL-2.0-only", ["gpl2-only-grant", "gpl-warranty"]),
    ("AGPL-3.0-or-later", ["agpl3-grant", "gpl-warranty"]),
    ("LGPL-2.1-or-later", ["lgpl21-grant", "lgpl-warranty"]),
    ("LGPL-3.0-or-later", ["lgpl3-grant", "lgpl-warranty"]),
    ("GPL-3.0-only", ["gpl3-title", "fsf-verbatim"]),
    ("GPL-2.0-only", ["gpl2-title", "fsf-verbatim"]),
    ("GPL-3.0-or-later", ["gpl3-grant"]),
    ("GPL-2.0-or-later", ["gpl2-grant"]),
    ("GPL-3.0-only", ["gpl3-only-grant"]),
    ("GPL-2.0-only", ["gpl2-only-grant"]),
    ("AGPL-3.0-or-later", ["agpl3-grant"]),
    ("LGPL-2.1-or-later", ["lgpl21-grant"]),
    ("LGPL-3.0-or-later", ["lgpl3-grant"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-title"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-2.0-only", ["gpl2-notice"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-title"]),
    ("0BSD", ["0bsd-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("BSL-1.0", ["bsl-notice"]),
    ("BSL-1.0", ["bsl-title"]),
    ("Unlicense", ["unlicense-grant"]),
    ("CC0-1.0", ["cc0-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("Proprietary", ["all-rights-reserved"]),
]
# Every known sentence holds one of these; texts without any are passed over. Single words, as the text isn't normalised yet.
HINTS = ["licen", "permission", "copyright", "redistribution", "program", "reserved", "warrant", "software", "reproduction", "mpl"]


def normalised(sentence: str) -> str:
    """Words in lower case, parted by blanks, or by ``~`` where a sentence end stands within."""
    text = re.sub(r"(?<=[.!?])\s+", "~", sentence.strip().lower())
    return re.sub(r" ?~ ?", "~", re.sub(r"[^\w~]+|_", " ", text)).strip(" ~")


# Normalised sentences and their identifiers.
SENTENCES = {normalised(s): i for i, s in PUBLISHED}


def sentences(text: Column) -> Column:
    """Pieces that end at a line break, or at a mark of sentence end before white space or the end."""
    return F.split(text, r"(?<=[.!?:;])\s+|\s*[\r\n]+\s*|(?<=[.!?])$")


def marked(text: Column) -> Column:
    """The normalised text with ``|`` for each line break, colon and semicolon and ``~`` for each sentence end, at both ends, and twice for an empty line.

    A list's number or letter in brackets at the beginning of a line is no part of the sentence.
    """
    text = F.regexp_replace(F.translate(F.lower(text), "|~", "//"), r"\r\n?", "\n")
    text = F.regexp_replace(text, r"(?m)^[ \t]*\(?[0-9a-z]{1,2}\)[ \t]+", "")
    text = F.regexp_replace(text, r"\n\s*\n", "~~")
    text = F.regexp_replace(text, r"(?<=[.!?])\s+", "~")
    text = F.concat(F.lit("~"), F.regexp_replace(text, r"(?<=[:;])\s+|\n", "|"), F.lit("~"))
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}|~]+", " "), r" ?([|~]) ?", "$1")


def matched(identifiers: Column, rules: list) -> Column:
    """The names of the rules that hold, in order; a rule takes its identifiers out of the sequence."""
    table = F.from_json(F.lit(json.dumps([{"name": n, "ids": " " + " ".join(ids) + " "} for n, ids in rules])), "array<struct<name:string,ids:string>>")
    start = F.struct(F.concat(F.lit(" "), F.array_join(identifiers, "  "), F.lit(" ")).alias("rest"), F.array().cast("array<string>").alias("names"))

    def step(a: Column, rule: Column) -> Column:
        ids = F.replace(rule["ids"], F.lit(" "), F.lit("  "))
        ids = F.substring(ids, F.lit(2), F.length(ids) - 2)
        held = F.contains(a["rest"], ids)
        return F.struct(F.when(held, F.replace(a["rest"], ids, F.lit(" # "))).otherwise(a["rest"]).alias("rest"), F.when(held, F.array_append(a["names"], rule["name"])).otherwise(a["names"]).alias("names"))

    return F.array_distinct(F.aggregate(table, start, step, lambda a: a["names"]))


def scan_licenses(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: list = RULES) -> DataFrame:
    """``doc_id, n_sentences, identifiers, licenses`` of each document with a known sentence."""
    lookup = F.from_json(F.lit(json.dumps({k.replace("~", " "): i for k, i in known.items()})), "map<string,string>")
    # A licence sentence may run over several lines, but not over an empty one; it begins and ends with a line, a sentence or a part of one.
    # Of those that begin at one place the longest counts.
    longest = "|".join(k.replace("~", "[ |~]").replace(" ", "[ |]").replace("[[ |]|~]", "[ |~]") for k in sorted(known, key=len, reverse=True))
    places = F.regexp_extract_all(F.col("marked"), F.lit(rf"(?<=[|~])(?:{longest})(?=[|~])"), 0)
    found = F.filter(F.transform(places, lambda p: F.try_element_at(lookup, F.regexp_replace(p, r"[|~]", " "))), lambda i: i.isNotNull())
    hint = F.lit(False)
    for h in HINTS:
        hint = hint | F.lower("text").contains(h)
    return (
        docs.where(F.col("text").isNotNull() & hint)
        .select("doc_id", F.size(sentences(F.col("text"))).cast("long").alias("n_sentences"), marked(F.col("text")).alias("marked"))
        .select("doc_id", "n_sentences", found.alias("identifiers"))
        .where(F.size("identifiers") > 0)
        .select("doc_id", "n_sentences", "identifiers", matched(F.col("identifiers"), rules).alias("licenses"))
    )
