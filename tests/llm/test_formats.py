import hashlib
import random
import re
import textwrap

from tintwerk.llm import chat_format, licenses


def test_conversations_come_back(spark):
    r = random.Random(8)
    bits = ["</s>", "[INST]", " [/INST]", "<<SYS:", ">>", "<</SYS>>", "<|next|>", "\\", "\\e", "e", "<s>", "ok", "\n", "é😀", " ", "<", "$1"]
    rows = []
    for c in range(60):
        for t in range(r.randrange(1, 7)):
            rows.append((c, t, r.choice(["user", "assistant", "assistant", "system", "to>>ol\\", "a>", "a", ">", None]), "".join(r.choice(bits) for _ in range(r.randrange(0, 9))) or None))
    rows += [(72, 0, "a>", "hello"), (73, 0, "a", ">hello"), (74, 0, ">>", ">"), *((75, t, "user", f"x{t}") for t in range(300))]
    rows += [(70, None, "user", "x"), (70, 1, "user", "b"), (70, 1, "user", "a"), (70, 1, "user", "a"), (None, 0, "assistant", "n"), (71, 0, "user", "</s>[INST] ok [/INST]"), (71, 1, "assistant", "</s>[INST] ok [/INST]")]
    table = spark.createDataFrame([(*x, "f", 1) for x in rows], "conv_id long, turn long, role string, text string, formatted string, turns int").repartition(5)
    formatted = chat_format.format_conversations(table).cache()
    got = {x.conv_id: x for x in chat_format.summarize(formatted).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        shown = "".join(f"{role}\n{t}\n" for role, t in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(shown.encode()).hexdigest()), turns
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = formatted.where("conv_id = 71").first().formatted
    assert one.count("[/INST]") == 1 and one.count("</s>") == 1
    assert len({r.formatted for r in formatted.where("conv_id in (72, 73)").collect()}) == 2
    merged = formatted.where("conv_id = 70").first().formatted
    assert merged == "<s>[INST] x<|next|>a<|next|>a<|next|>b [/INST]"
    assert chat_format.summarize(chat_format.format_conversations(spark.createDataFrame([], table.schema))).count() == 0


def test_licences(spark):
    mit = "The MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [
        (1, "Text. Released under the MIT License.\nmehr"),
        (2, "Licensed under the Apache License, Version 2.0."),
        (3, "This work is licensed under the GNU General Public License, version 3. Released under the MIT License."),
        (4, mit),
        (5, "Kein Hinweis auf eine license hier."),
        (6, None),
        (7, ""),
        (8, "LICENSED UNDER CC BY-NC 4.0."),
        (8, "LICENSED UNDER CC BY-NC 4.0."),
        (None, "Released under the MIT License. Released under the MIT License."),
    ]
    got = licenses.scan_licenses(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, licenses string, pieces int")).collect()
    found = sorted(((r.doc_id, r.identifiers, r.licenses) for r in got), key=str)
    assert found == sorted(
        [
            (1, ["mit-notice"], ["MIT"]),
            (2, ["apache-notice"], ["Apache-2.0"]),
            (3, ["gpl3-notice", "mit-notice"], ["MIT", "GPL-3.0-only"]),
            (4, ["mit-title", "mit-grant", "mit-condition"], ["MIT"]),
            (8, ["cc-by-nc-notice"], ["CC-BY-NC-4.0"]),
            (8, ["cc-by-nc-notice"], ["CC-BY-NC-4.0"]),
            (None, ["mit-notice", "mit-notice"], ["MIT"]),
        ],
        key=str,
    )
    assert all(any(h in s for h in licenses.HINTS) for s in licenses.SENTENCES)
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


MIT = [
    "The MIT License",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
]
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
]


def wrapped(parts, width=72, prefix="", end="\n"):
    return (end + prefix.rstrip() + end).join(textwrap.fill(p, width, initial_indent=prefix, subsequent_indent=prefix).replace("\n", end) for p in parts)


def scanned(spark, texts):
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: (r.identifiers, r.licenses) for r in got}


def test_wrapped_licences(spark):
    forms = [(72, "", "\n"), (40, "", "\r\n"), (78, " * ", "\n"), (78, "# ", "\r"), (10000, "", "\n")]
    wants = [
        (MIT, ["mit-title", "mit-grant", "mit-condition"], ["MIT"]),
        (BSD, ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"], ["BSD-3-Clause"]),
        (APACHE, ["apache-notice", "apache-compliance", "apache-copy", "apache-warranty"], ["Apache-2.0"]),
    ]
    cases = [(wrapped(parts, *form), ids, names) for form in forms for parts, ids, names in wants]
    got = scanned(spark, [c[0] for c in cases])
    for k, (text, ids, names) in enumerate(cases):
        assert got.get(k) == (ids, names), text
    # An empty line ends a sentence; a sentence within a line stays unknown.
    assert not scanned(spark, ["released under\n\nthe mit license terms", "see the MIT License for more"])


def gpl(version, grant):
    return [
        f"This program is free software{grant[0]} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{grant[1]} either version {version} of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.",
    ]


def test_gpl_and_every_sentence_as_published(spark):
    notices = [(3, ":,"), (2, ";;"), (2, ";,"), (3, ":;")]
    got = scanned(spark, [wrapped(gpl(*n), *form) for n in notices for form in ((72, "", "\n"), (10000, "", "\n"), (60, "// ", "\r\n"))])
    for k in range(12):
        v = notices[k // 3][0]
        assert got.get(k) == ([f"gpl{v}-grant", "gpl-warranty", "gpl-details"], [f"GPL-{v}.0-or-later"])
    for width in (72, 10000):
        got = scanned(spark, [wrapped([t for _, t in licenses.PUBLISHED], width)])
        assert got[0][0] == [i for i, _ in licenses.PUBLISHED]


def test_hints_pass_other_spacing(spark):
    texts = ["All  rights reserved.", "All\u00a0rights\u00a0reserved.", "all-rights-reserved", "All rights\nreserved.", gpl(3, ":,")[1].split("  See")[0].replace("program is", "program\nis")]
    got = scanned(spark, texts)
    assert [got.get(k, [None])[0] for k in range(5)] == [["all-rights-reserved"]] * 4 + [["gpl-warranty"]]


def plain_scan(text):
    """Token by token: at each place after a line or sentence end, the longest known sentence that also ends at one."""
    known = {tuple(k.replace("~", " ").split()): i for k, i in licenses.SENTENCES.items()}
    inner = {tuple(k.replace("~", " ").split()): {k[: m.start()].replace("~", " ").count(" ") for m in re.finditer("~", k)} for k in licenses.SENTENCES}
    # Tokens: words, line marks and sentence marks.
    tokens = []
    for paragraph in re.split(r"\n[^\S\n]*\n\s*", text.lower().replace("\r\n", "\n").replace("\r", "\n")):
        tokens += ["~"]
        for line in paragraph.split("\n"):
            line = re.sub(r"^[ \t]*\(?[0-9a-z]{1,2}\)[ \t]+", "", line)
            tokens += ["|"]
            for piece in line.split():
                tokens += re.findall(r"[^\W_]+", piece)
                tokens += ["~"] if piece[-1] in ".!?" else ["|"] if piece[-1] in ":;" else []
    tokens += ["~"]
    out, i = [], 0
    while i < len(tokens):
        best = None
        if tokens[i - 1] in "|~" and i and tokens[i] not in "|~":
            for words, name in known.items():
                k, j = i, 0
                while j < len(words) and k < len(tokens):
                    if tokens[k] == "|" or tokens[k] == "~" and j - 1 in inner[words]:
                        k += 1
                    elif tokens[k] == words[j]:
                        k, j = k + 1, j + 1
                    else:
                        break
                if j == len(words) and tokens[k] in "|~" and (best is None or k > best[0]):
                    best = k, name
        if best:
            out.append(best[1])
        i = best[0] if best else i + 1
    return out


def plain_rules(ids):
    out, rest = [], list(ids)
    for name, rule in licenses.RULES:
        i = 0
        while i <= len(rest) - len(rule):
            if rest[i : i + len(rule)] == rule:
                rest[i : i + len(rule)] = ["#"]
                out += [name] if name not in out else []
            i += 1
    return out


def test_scan_equals_plain_scan(spark):
    r = random.Random(4)
    texts = [MIT[0] + "\n(c) 2020\n" + "\n\n".join(MIT[1:]), "1) " + BSD[1] + "\n(b) " + BSD[2], "x " * 300_000 + "\nAll rights reserved."]
    for _ in range(120):
        parts = []
        for _ in range(r.randrange(1, 7)):
            parts.append(r.choice(licenses.PUBLISHED)[1] if r.random() < 0.7 else r.choice(["Some words here.", "Copyright (c) 2001 somebody", "the MIT License says: no", ""]))
            if r.random() < 0.15:
                parts[-1] = parts[-1].replace(" the ", " a ", 1)
        text = r.choice([" ", "\n", "\n\n", "\r\n"]).join(parts)
        texts.append(textwrap.fill(text, 60) if r.random() < 0.3 else text.upper() if r.random() < 0.2 else text)
    got = scanned(spark, texts)
    for k, text in enumerate(texts):
        ids = plain_scan(text)
        assert got.get(k, ([], []))[0] == ids, text
        assert not ids or got[k][1] == plain_rules(ids), (text, ids)
    assert len(got) > 80


def test_scan_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.identifiers for r in licenses.scan_licenses(docs).collect()}
    want = {r.doc_id: ids for r in docs.collect() if r.text and (ids := plain_scan(r.text))}
    assert got == want and len(want) > 10
