import hashlib
import random
import re

from pyspark.sql import functions as F

from straitline.llm import secrets as S

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(t):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


def spans(docs, **k):
    entries, addressed = S.scan(docs, **k)
    base = F.filter("_spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return {(r.doc_id, r.text): r.s.split(",") if r.s else [] for r in S.findings_by_path(addressed, entries).select("doc_id", "text", S.span_list(base).alias("s")).collect()}


def test_base_spans_against_brute_force(make):
    r = random.Random(4)
    parts = ["token", "Token=", "secret:abc ", "api_key = 'abcdefgh", "API-KEY:", "apikey:\"", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef" * 4, "0f", " ", "\n", "é", "😀", "password==", "x=secret:abcdefghi", "PassWord : Zz9_-+/=.", "g", "ſecret=abcdefghij"]
    texts = [(i, "".join(r.choice(parts) for _ in range(r.randrange(0, 25)))) for i in range(400)]
    got = spans(make(texts))
    assert got == {(i, t): brute(t) for i, t in texts}


def test_ledger_scans_only_unseen_pairs(make):
    first, _ = S.scan(make([(1, "token=abcdefgh1"), (2, "clean")]))
    second, addressed = S.scan(make([(3, "token=abcdefgh1"), (4, "secret=abcdefgh2"), (5, "clean")]), ledger=first)
    address = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {r.blob for r in second.collect()} == {address("secret=abcdefgh2")}
    found = S.findings_by_path(addressed, first.unionByName(second))
    assert {r.doc_id: len(r._spans) for r in found.collect()} == {3: 1, 4: 1, 5: 0}
    again, _ = S.scan(make([(3, "token=abcdefgh1")]), ledger=first, rule_version="2")
    assert again.count() == 1


def test_edges(docs, no_docs):
    got = spans(docs)
    assert len(got) == docs.select("doc_id", "text").distinct().count()
    assert all(v == brute(t) for (_, t), v in got.items())
    assert spans(no_docs) == {}
    entries, addressed = S.scan(docs)
    assert S.findings_by_path(addressed, entries).count() == docs.count()
    assert S.empty_ledger(docs.sparkSession).schema == entries.schema or S.empty_ledger(docs.sparkSession).columns == entries.columns


def test_very_long_text_is_linear(make):
    text = "token = " + "a" * 10 + " " + "password " * 200_000 + "AKIA" + "B" * 20
    assert spans(make([(1, text)]))[1, text] == brute(text)
