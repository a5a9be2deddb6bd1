import random
import re

from straitline.llm import pii as P


def brute(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for k, pattern, lo, hi in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if lo <= len(d) <= hi and (k == 3 or P.luhn(d)):
                found.append((m.start(), k, m.end()))
    return [(a, b, P.KINDS[k]) for a, k, b in sorted(found)]


def test_base_spans_against_the_patterns():
    r = random.Random(2)
    for _ in range(20_000):
        t = "".join(r.choice("ab19.@+-() %_0") for _ in range(r.randrange(40)))
        assert P.base_spans(t) == brute(t), t


def test_long_runs_are_linear():
    for t in ("a" * 500_000, "1" * 500_000, "1." * 200_000, "+1" + "(" * 300_000, "a@" * 200_000, "@" * 300_000):
        P.base_spans(t)


def test_field_adds_forms_that_the_patterns_miss():
    r = random.Random(3)
    card = lambda: next(d for d in iter(lambda: "4" + "".join(r.choice("0123456789") for _ in range(15)), "") if P.luhn(d))
    base = [x for i in range(60) for x in (f"by user.{i}@mail{i % 7}.example.com ok", f"at {r.randrange(9, 250)}.{r.randrange(250)}.{r.randrange(250)}.{r.randrange(250)} here", f"pay {card()} now", f"ring +1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)} today")]
    w = P.train([(t, P.base_spans(t)) for t in base])
    kinds = lambda t: [k for _, _, k in P.spans_of(t, w)]
    assert kinds("call (202) 555-0143 now") == ["x_phone"]
    assert kinds("write ann.lee (at) mail4.example.com soon") == ["x_email"]
    for clean in ("on 2024-01-05 10:33 at 3.14", "version 2.0.1 of 1999", "about 1,234,567,890 people", "no numbers at all"):
        assert kinds(clean) == [], clean
    t = "see a.b@c.example.org and 10.2.3.4"
    assert set(P.base_spans(t)) <= set(P.spans_of(t, w))


def test_edges(docs, no_docs):
    rows = P.find(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: [s.kind for s in r.spans] for r in rows}
    assert by[1] == by[2] == by[7] == [] and by[10][:2] == ["email", "phone"]
    assert P.find(no_docs).collect() == []
    out = P.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = {r.doc_id: r for r in out.collect()}
    assert text[10].text.startswith("mail [EMAIL] or [PHONE] token") and text[10].n_chars == len(text[10].text)
    assert text[4].text == "the cat sat on the mat and looked at the moon" and text[1].text is None


def test_long_runs_are_read_to_their_end():
    r = random.Random(3)
    base = [x for i in range(60) for x in (f"by user.{i}@mail{i % 7}.example.com ok", f"at {r.randrange(9, 250)}.{r.randrange(250)}.{r.randrange(250)}.{r.randrange(250)} here", f"ring +1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)} today")]
    w = P.train([(t, P.base_spans(t)) for t in base])
    found = lambda t: [t[a:b] for a, b, k in P.spans_of(t, w) if k == "x_phone"]
    for fill in ("k,", "abc;", "x" * 2_000 + ";"):
        run = (fill * 5_000)[: 5_000 // len(fill) * len(fill)]
        assert found(f"{run}tel:202-555-0143") == ["202-555-0143"]
        assert found(f"{run}tel:202-555-0143;{run}") == ["202-555-0143"]
    for shift in range(330, 480):  # over any place where the run was cut
        t = "12, " * (shift // 4) + "a1b"[: shift % 4] + " tel: 202 555 0143 x1"
        assert P.base_spans(t) == [] and found(t) == ["202 555 0143"], shift
    atoms = P._ATOM.findall(t := "ab1," * 3_000)
    got = list(P.islands(t))
    assert got[0][0] == 0 and got[-1][1] == len(t) and all(x[3] == y[2] for x, y in zip(got, got[1:])) and len(atoms) > 1000
