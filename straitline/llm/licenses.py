"""License scans by sentence rules: known sentences become identifiers, rules match sequences of identifiers.

A text is read as lower-cased runs of letters and digits. Sentences may begin and end at line ends, sentence marks that
blanks follow, and before links. A known sentence is found where all its words stand between two such places, whatever marks
and single line breaks are inside it; a line without words ends it. A slot, words in braces, in a known sentence stands
for one to MAX_SLOT words, as few as possible: a holder's name, say. The longest wins, and the search goes on behind it. A
rule is a license and an ordered list of identifiers; it matches a place where they follow in order with at most MAX_GAP
unknown sentences between neighbours, and unknown sentences run over single line breaks too. Rules are tried longest first
at each place, and a sentence belongs to one match, so the notice inside a full license text isn't reported beside it.

Cases: null and empty texts match nothing; a long text is read once; the same notice twice is two matches; repeated rows
are scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column

MAX_GAP, MAX_SLOT = 2, 12

#: Sentences of public license notices, by identifier.
SENTENCES: dict[str, str] = {
    "mit.title": "The MIT License",
    "mit.title2": "MIT License",
    "mit.notice": "Released under the MIT License",
    "mit.notice2": "Licensed under the MIT License",
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit.keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit.asis": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache.notice": "Licensed under the Apache License, Version 2.0",
    "apache.notice2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache.obtain": "You may obtain a copy of the License at",
    "apache.asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3.notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl3.notice2": "Licensed under the GNU General Public License, version 3",
    "gpl2.notice": "Licensed under the GNU General Public License, version 2",
    "gpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl.free2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl.notice": "Licensed under the GNU Lesser General Public License, version 3",
    "agpl.notice": "Licensed under the GNU Affero General Public License, version 3",
    "mpl.notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl.copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd.endorse": "Neither the name of {the copyright holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0": "Released under CC0 1.0",
    "ccby.notice": "Licensed under CC BY 4.0",
    "ccbysa.notice": "Licensed under CC BY-SA 4.0",
    "ccbync.notice": "Licensed under CC BY-NC 4.0",
    "ccbyncnd.notice": "Licensed under CC BY-NC-ND 4.0",
    "reserved": "All rights reserved",
    "mit.notice3": "This code is under the MIT License",
    "bsd.endorse2": "The name of {the author} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "lgpl21.free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl21.hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl3.title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2.title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "epl.notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "boost.notice": "Distributed under the Boost Software License, Version 1.0.",
    "zlib.asis": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib.liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}

#: Fixed values: (license, ordered identifiers).
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit.title", "mit.grant", "mit.keep", "mit.asis")), ("MIT", ("mit.title2", "mit.grant", "mit.keep", "mit.asis")), ("MIT", ("mit.grant", "mit.keep", "mit.asis")), ("MIT", ("mit.grant", "mit.keep")), ("MIT", ("mit.grant",)), ("MIT", ("mit.notice",)), ("MIT", ("mit.notice2",)), ("MIT", ("mit.title",)), ("MIT", ("mit.title2",)),
    ("Apache-2.0", ("apache.notice2", "apache.obtain", "apache.asis")), ("Apache-2.0", ("apache.notice2",)), ("Apache-2.0", ("apache.notice",)),
    ("GPL-3.0", ("gpl.free", "gpl.hope")), ("GPL-3.0", ("gpl.free",)), ("GPL-3.0", ("gpl3.notice",)), ("GPL-3.0", ("gpl3.notice2",)), ("GPL-2.0", ("gpl.free2", "gpl.hope")), ("GPL-2.0", ("gpl.free2",)), ("GPL-2.0", ("gpl2.notice",)), ("LGPL-3.0", ("lgpl.notice",)), ("AGPL-3.0", ("agpl.notice",)),
    ("MPL-2.0", ("mpl.notice", "mpl.copy")), ("MPL-2.0", ("mpl.notice",)),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")), ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")), ("BSD-2-Clause", ("bsd.grant",)),
    ("ISC", ("isc.grant",)), ("Unlicense", ("unlicense",)), ("CC0-1.0", ("cc0",)), ("CC-BY-4.0", ("ccby.notice",)), ("CC-BY-SA-4.0", ("ccbysa.notice",)), ("CC-BY-NC-4.0", ("ccbync.notice",)), ("CC-BY-NC-ND-4.0", ("ccbyncnd.notice",)), ("All-Rights-Reserved", ("reserved",)),
    ("MIT", ("mit.notice3",)), ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse2")),
    ("LGPL-2.1", ("lgpl21.free", "lgpl21.hope")), ("LGPL-2.1", ("lgpl21.free",)), ("GPL-3.0", ("gpl3.title",)), ("GPL-2.0", ("gpl2.title",)), ("EPL-2.0", ("epl.notice",)), ("BSL-1.0", ("boost.notice",)), ("Zlib", ("zlib.asis", "zlib.liable", "zlib.grant")), ("Zlib", ("zlib.grant",)),
)

# each license above has its identifier line too, those with versions of their own in three forms
for _name in dict.fromkeys(name for name, _ in RULES if name != "All-Rights-Reserved"):
    for _form in ("", "-only", "-or-later") if "GPL" in _name else ("",):
        SENTENCES[f"spdx.{_name}{_form}"] = f"SPDX-License-Identifier: {_name}{_form}"
        RULES += ((_name, (f"spdx.{_name}{_form}",)),)

SLOT = "{}"
_SLOT = re.compile(r"\{[^}]*\}")
_TOKEN = re.compile(r"[^\W_]+")
#: Where a sentence ends (and the next begins), among the characters between two words.
_CUT = re.compile(r"\n|(?<=[.!?:;])[^\S\n]+")
_STOP = re.compile(r"[.!?:;]\s")
_LINK = re.compile(r"https?://", re.I)


def normalise(sentence: str) -> str:
    """Words of a known sentence, with SLOT for its slots."""
    return f" {SLOT} ".join(" ".join(_TOKEN.findall(part.lower())) for part in _SLOT.split(sentence))


def matched(words: list[str], k: int, known: list[str]) -> int | None:
    """Where a known sentence that starts at word k ends, or None."""
    i = 0
    while i < len(known):
        end = known.index(SLOT, i) if SLOT in known[i:] else len(known)
        part = known[i:end]
        for at in range(k + 1, k + MAX_SLOT + 1) if i else (k,):
            if words[at : at + len(part)] == part:
                k = at + len(part)
                break
        else:
            return None
        i = end + 1
    return k


class Words:
    """The words of a text, and what stands between them."""

    def __init__(self, text: str):
        spans = [m.span() for m in _TOKEN.finditer(text)]
        self.text, self.words = text, [text[a:b].lower() for a, b in spans]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def cuts(self, k: int) -> list[re.Match]:
        """Cuts between word k - 1 and word k."""
        return list(_CUT.finditer(self.text, self.ends[k - 1] if k else 0, self.starts[k] if k < len(self.words) else len(self.text)))

    def begin(self, k: int) -> int | None:
        """Where a sentence that has word k first begins, or None."""
        cuts = self.cuts(k)
        return cuts[-1].end() if cuts else None if k else 0

    def end(self, k: int) -> int | None:
        """Where a sentence that has word k - 1 last ends, or None."""
        cuts = self.cuts(k)
        if cuts:
            return cuts[0].start()
        return len(self.text) if k == len(self.words) else self.ends[k - 1] if _LINK.match(self.text, self.starts[k]) else None

    def broken(self, k: int) -> bool:
        """A line without words before word k."""
        return self.text.count("\n", self.ends[k - 1], self.starts[k]) > 1

    def begun(self) -> list[int]:
        """Sentences that begin up to each word; one runs over single line breaks, unless a mark stands before them."""
        return list(accumulate(not k or self.broken(k) or bool(_STOP.search(self.text, self.ends[k - 1], self.starts[k])) for k in range(len(self.words))))


class Scanner:
    """Tables of a set of sentences and rules."""

    def __init__(self, known: dict[str, str] = SENTENCES, rules=RULES):
        self.ids = {normalise(s): i for i, s in known.items()}
        words = [k.split() for k in self.ids]
        self.first: dict[str, list[list[str]]] = {}
        for w in sorted(words, key=len, reverse=True):
            self.first.setdefault(w[0], []).append(w)
        self.rules: dict[str, list[tuple[str, tuple[str, ...], int]]] = {}
        for r, (name, seq) in enumerate(rules):
            self.rules.setdefault(seq[0], []).append((name, seq, r))
        for of in self.rules.values():
            of.sort(key=lambda x: (-len(x[1]), x[2]))
        # a text without any of these is clean: one of the words of each sentence, the longest
        self.probe = re.compile("|".join(sorted({max(w, key=lambda x: (len(x) if x != SLOT else 0, x)) for w in words})))

    def scan(self, text: str | None) -> list[dict]:
        """Matches in order: license, rule, start, end (code points), sentences."""
        if not text or not self.probe.search(text.lower()):
            return []
        t = Words(text)
        seen: list[tuple[int, int, str, int, int]] = []
        k = 0
        while k < len(t.words):
            n = 0
            if t.words[k] in self.first and (a := t.begin(k)) is not None:
                for known in self.first[t.words[k]]:
                    j = matched(t.words, k, known)
                    if j is not None and (b := t.end(j)) is not None and not any(t.broken(i) for i in range(k + 1, j)):
                        seen.append((k, j, self.ids[" ".join(known)], a, b))
                        n = j - k
                        break
            k += n or 1
        begun = t.begun() if len(seen) > 1 else []
        far = lambda i, j: seen[j][0] > seen[i][1] and 1 + begun[seen[j][0] - 1] - begun[seen[i][1]] > MAX_GAP
        out, used, at = [], set(), 0
        for at in range(len(seen)):
            if at in used:
                continue
            for name, seq, r in self.rules.get(seen[at][2], ()):
                places, nxt = [at], at + 1
                for want in seq[1:]:
                    while nxt < len(seen) and (nxt in used or seen[nxt][2] != want) and not far(places[-1], nxt):
                        nxt += 1
                    if nxt >= len(seen) or seen[nxt][2] != want or far(places[-1], nxt):
                        break
                    places.append(nxt)
                    nxt += 1
                if len(places) == len(seq):
                    used.update(places)
                    out.append({"license": name, "rule": r, "start": seen[places[0]][3], "end": seen[places[-1]][4], "sentences": len(seq)})
                    break
        return out


MATCH = "struct<license:string,rule:int,start:bigint,end:bigint,sentences:int>"


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """(id, matches), one row per row of ``docs``."""
    s = scanner or Scanner()
    kind = docs.schema[id_col].dataType.simpleString()
    struct = pa.struct([("license", pa.string()), ("rule", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("sentences", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.scan(t) for t in column(batch, "text")], pa.list_(struct))], names=["id", "matches"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, matches array<{MATCH}>").withColumnRenamed("id", id_col)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    return rows.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"), spans.alias("spans"))
