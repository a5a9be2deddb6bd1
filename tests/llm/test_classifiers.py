import random
import textwrap

import numpy as np
import pytest

from straitline.llm import langid as L
from straitline.llm import licenses as C
from straitline.llm import quality as Q


def test_language_is_learned_and_held_out(make):
    r = random.Random(6)
    syllables = {"en": ["th", "ing", "er", "wh"], "de": ["sch", "ung", "ä", "tz"], "fr": ["eau", "é", "que", "oi"]}
    texts, langs = [], {}
    for i in range(600):
        lang = r.choice(list(syllables))
        texts.append((i, " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(20))))
        langs[i] = lang
    docs = make(texts, langs=langs)
    model = L.fit(docs.where("doc_id % 4 <> 2").select("text", "lang"))
    rows = L.identify(docs, model).collect()
    held = [x for x in rows if x.doc_id % 4 == 2]
    assert sum(x.lang_pred == langs[x.doc_id] for x in held) >= 0.99 * len(held) and all(0 <= x.score <= 1 for x in rows)


def test_backoff_goes_to_shorter_grams():
    m = L.Model(["a", "b"], {"known": {"a": -1.0, "b": -3.0}}, [{"x": {"a": -2.0}}, {"xy": {"b": -1.5}}, {}, {}])
    assert m.score([["known"]]).tolist() == [[-1.0, -3.0]]
    assert m.back_off(["xy"]).tolist() == [[L.PENALTY, -1.5]]  # two letters before one
    assert m.back_off(["xz"]).tolist() == [[-2.0, L.PENALTY]]
    assert m.back_off(["qq"]).tolist() == [[L.PENALTY, L.PENALTY]]


def plain_scores(langs, words, ngrams, ws):
    """Mean score of a text by plain dictionaries."""

    def of(w, lang):
        if w in words:
            return words[w].get(lang, L.PENALTY)
        for n in range(len(ngrams), 0, -1):
            found = [ngrams[n - 1][g] for g in L.grams(w, n) if g in ngrams[n - 1]]
            if found:
                return sum(by.get(lang, L.PENALTY) for by in found) / len(found)
        return L.PENALTY

    return [sum(of(w, lang) for w in ws) / len(ws) for lang in langs]


@pytest.mark.parametrize("limit", [7, 60, 4_000_000])
def test_sparse_scores_equal_plain_ones(monkeypatch, limit):
    r, langs = random.Random(9), [f"l{i:02}" for i in range(12)]
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 6)))
    scores = lambda: {lang: -r.uniform(1, 7) for lang in r.sample(langs, r.randrange(1, 5))}
    words = {word(): scores() for _ in range(60)}
    ngrams = [{g: scores() for g in {g for _ in range(6) for g in L.grams(word(), n)}} for n in range(1, 5)]
    docs = [[word() for _ in range(r.randrange(0, 40))] for _ in range(50)]
    monkeypatch.setattr(L, "PAIRS", limit)
    monkeypatch.setattr(L, "CELLS", limit)
    m, memory = L.Model(langs, words, ngrams), []
    for part in (docs[:20], docs[20:], docs[:5]):
        got = m.score(part, memory)
        for row, ws in zip(got, part):
            assert np.isnan(row).all() if not ws else np.allclose(row, plain_scores(langs, words, ngrams, ws), rtol=0, atol=1e-9)
        assert len(memory) <= 1


def test_more_languages_than_any_table_of_old(make):
    r = random.Random(2)
    own = {f"l{i:03}": ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(5)] for i in range(600)}
    texts = [(i, " ".join(r.choice(own[f"l{i % 600:03}"]) for _ in range(12))) for i in range(1800)]
    langs = {i: f"l{i % 600:03}" for i, _ in texts}
    docs = make(texts, langs=langs)
    model = L.fit(docs.where("doc_id < 1200").select("text", "lang"))
    rows = L.identify(docs.where("doc_id >= 1200"), model).collect()
    assert len(model.langs) == 600 and len(model.words.value) <= 3000
    assert sum(x.lang_pred == langs[x.doc_id] for x in rows) >= 0.99 * len(rows) == 594.0


def test_language_edges(docs, no_docs):
    model = L.fit(docs.select("text", "lang"))
    rows = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[4].lang_pred == "en"
    assert L.identify(docs, model).count() == docs.count()
    empty = L.fit(no_docs.select("text", "lang"))
    assert {r.lang_pred for r in L.identify(docs, empty).collect()} == {"und"}
    assert L.text_words("½ 3 ٣ !") == [] and L.text_words("m² x") == ["m²", "x"]


@pytest.fixture
def labelled(spark, make):
    r = random.Random(7)
    texts, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(30)]
        texts.append((i, (" ".join(w).capitalize() + ".") if good else r.choice([" | ".join(w), " ".join(x.upper() + "!!" for x in w), " ".join(w[:1] * 30)])))
        labels.append((i, int(good)))
    return make(texts), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    m = Q.fit(docs, labels.where("doc_id % 5 <> 0"))
    rows = Q.score(docs, m, keep={"doc_id": docs["doc_id"]}).collect()
    held = [r for r in rows if r.doc_id % 5 == 0]
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_pairs_by_the_sum_of_squares():
    m = Q.Machine(0.3)
    rng = np.random.default_rng(1)
    m.w[:] = rng.normal(size=len(m.w))
    idx, val, n = Q.features([b"one two three", b"", b"a a a"])
    got, at = m.parts(idx, val, n)[0], 0
    for k, size in enumerate(n):
        i, x = idx[at : at + size], val[at : at + size]
        pairs = sum(float(m.v[i[a]] @ m.v[i[b]]) * x[a] * x[b] for a in range(size) for b in range(a))
        assert abs(got[k] - (0.3 + float(m.w[i] @ x) + pairs)) < 1e-3
        at += size


def test_quality_edges(spark, docs, no_docs, labelled):
    _, labels = labelled
    none = labels.limit(0)
    assert {r.score for r in Q.score(docs, Q.fit(docs, none), keep={"doc_id": docs["doc_id"]}).collect()} == {0.5}
    m = Q.fit(docs, spark.createDataFrame([(4, 1), (4, 0), (None, 1), (7, None), (9, 7), (5, 1)], "doc_id long, quality int"))
    rows = Q.score(docs, m, keep={"doc_id": docs["doc_id"]})
    assert rows.count() == docs.count() and Q.score(no_docs, m, keep={"doc_id": no_docs["doc_id"]}).collect() == []
    assert Q.accept(docs, none).columns == docs.columns


def test_license_sequences():
    s = C.Scanner()
    mit = "\n".join(C.SENTENCES[k] for k in ("mit.title", "mit.grant", "mit.keep", "mit.asis"))
    assert [(m["license"], m["sentences"]) for m in s.scan(f"// header\n{mit}\nfoot")] == [("MIT", 4)]
    gap = mit.replace("\nThe above", "\nCopyright (c) someone\nThe above")
    assert [(m["license"], m["sentences"]) for m in s.scan(gap)] == [("MIT", 4)]
    far = mit.replace("\nThe above", "\nx1\nx2\nx3\nThe above")
    assert [m["sentences"] for m in s.scan(far)] == [1, 1] or [m["license"] for m in s.scan(far)][0] == "MIT"
    t = "words.\nLICENSED under the Apache License,  Version 2.0.\nAll rights reserved."
    assert [(m["license"], t[m["start"] : m["end"]]) for m in s.scan(t)] == [("Apache-2.0", "LICENSED under the Apache License,  Version 2.0."), ("All-Rights-Reserved", "All rights reserved.")]
    assert s.scan("the license of the project is free") == [] and s.scan(None) == [] and s.scan("") == []


def test_license_edges(docs, no_docs):
    assert C.find(docs).count() == docs.count() and C.find(no_docs).collect() == []


def test_license_slots_and_identifier_lines():
    s = C.Scanner()
    names = lambda t: [m["license"] for m in s.scan(t)]
    bsd = "\n".join(C.SENTENCES[k] for k in ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")).replace("{the copyright holder}", "{}")
    for holder in ("the University", "the copyright holder", "Example Labs, Inc.", "X", "the Regents of the State Technical College of Somewhere in the North"):
        assert names(textwrap.fill(bsd.replace("{}", holder), 72)) == ["BSD-3-Clause"], holder
    assert names(bsd.replace("{}", " ".join(f"w{i}" for i in range(C.MAX_SLOT + 1)))) == ["BSD-2-Clause"]
    assert names(bsd.replace("{} ", "")) == ["BSD-2-Clause"]  # a slot has a word at least
    for line, name in (("// SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("/* SPDX-License-Identifier: BSL-1.0 */", "BSL-1.0"), ("SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1")):
        assert names(f"{line}\n\nint main;") == [name], line
    assert names("x SPDX-License-Identifier: MITX") == [] and names("This code is under the MIT License.") == ["MIT"]
    assert names("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright") == ["GPL-3.0"]


def test_slots_against_all_ways_to_fill_them():
    def brute(words, k, known):
        if not known:
            return k
        if known[0] != C.SLOT:
            return brute(words, k + 1, known[1:]) if words[k : k + 1] == known[:1] else None
        return next((e for n in range(1, C.MAX_SLOT + 1) if k + n <= len(words) and (e := brute(words, k + n, known[1:])) is not None), None)

    r = np.random.default_rng(3)
    hits = 0
    for _ in range(3000):
        words = list(r.choice(["a", "b", "c"], 9))
        known = ["a", C.SLOT, *r.choice(["a", "b", "c"], 2), *([C.SLOT, "c"] if r.random() < 0.5 else [])]
        want = brute(words, 0, known)
        hits += want is not None
        got = C.matched(words, 0, known)
        assert (got is None) == (want is None) and (got is None or got == want), (words, known)
    assert hits > 300


def test_every_license_rule_on_its_own_text():
    s = C.Scanner()
    for r, (name, seq) in enumerate(C.RULES):
        plain = "\n\n".join(C.SENTENCES[k] for k in seq)
        wrapped = "\n\n".join(textwrap.fill(C.SENTENCES[k], 72) for k in seq)
        comment = "\n".join(f" * {x}" for x in wrapped.split("\n"))
        for t in (plain, plain.replace("\n\n", "\n"), wrapped, wrapped.replace("\n\n", "\n"), textwrap.indent(wrapped, "    "), comment, wrapped.replace("\n", "\r\n")):
            assert [(m["license"], m["rule"]) for m in s.scan(f"Some text before.\n\n{t}\n\nand after")] == [(name, r)], t
    header = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n"
    assert [(m["license"], m["sentences"]) for m in s.scan(header)] == [("Apache-2.0", 1)]
    assert [m["sentences"] for m in s.scan(header + "\n" + textwrap.fill(C.SENTENCES["apache.asis"], 76))] == [3]
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
    assert [(m["license"], m["sentences"]) for m in s.scan(mpl)] == [("MPL-2.0", 2)]
    assert s.scan("This Source Code Form is subject to the\n\nterms of the Mozilla Public License, v. 2.0.") == []
