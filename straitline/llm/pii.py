"""Personal data by patterns and a semi-Markov conditional random field.

Base spans follow four patterns with checks. They are found around anchors (an ``@``, a ``+``, the start of a digit run),
in time linear in the text, with the results of the leftmost non-overlapping scan. Beside them a semi-Markov CRF reads
the neighbourhoods that hold a digit or an at-sign ("islands"): whole-span features (digit groups, checksum, separators,
shape, context) score candidate segments of bounded length, and dynamic programming over segments chooses boundaries and
types together. It is trained here, on islands of the corpus itself: base spans are its labels, rewritten copies (an
obfuscated at-sign, a phone number without its plus, a card with other separators) carry the labels of their originals,
and all else is outside. Entities it finds that touch no base span are added under the kinds ``x_email`` and so on, so
counts of the four base kinds stay those of the patterns.

Cases: a null text counts as empty and has no spans; repeated rows and ids are rows of their own; an empty table gives an
empty result; if no island is there to learn from, the field adds nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, to_batch

KINDS = ("email", "ip", "card", "phone")
#: Islands that the field learns from, the smallest by hash, and passes over them.
SAMPLE_ISLANDS, EPOCHS, STEP, DECAY = 600, 6, 0.3, 1e-3
#: Longest candidate in atoms, and half the longest island in characters; a longer run is cut into islands that overlap.
MAX_ATOMS, MAX_ISLAND = 24, 400

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the four patterns, by start, then kind as listed."""
    found: list[tuple[int, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


# ---- islands, atoms, candidates and their features ----

_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_PIECE = re.compile(rf"[A-Za-z]{{1,{MAX_ISLAND}}}|[0-9]{{1,{MAX_ISLAND}}}|\s{{1,{MAX_ISLAND}}}|.", re.S)  # atoms, none without end
_WORD = re.compile(r"\S+")
_NUMBER = re.compile(r"[0-9 ().+-]+")  # what numbers of persons are written with
_LINK = re.compile(r"[(\[]?(?:at|dot)[)\]]?", re.I)


def islands(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Neighbourhoods of triggers: words with a digit or at-sign, joined when adjacent, and the word before and after.

    (start, end, first and last limit of the places where its entities begin), see ``pieces``.
    """
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    hot = [bool(_TRIGGER.search(text, a, b)) for a, b in words]
    i, n = 0, len(words)
    while i < n:
        if not hot[i]:
            i += 1
            continue
        j = i
        while j + 1 < n and words[j + 1][0] - words[j][1] <= 2 and (hot[j + 1] or _LINK.fullmatch(text[words[j + 1][0] : words[j + 1][1]])):
            j += 1
        a = max(words[max(i - 1, 0)][0], words[i][0] - 40)
        b = min(words[min(j + 1, n - 1)][1], words[j][1] + 40)
        yield from pieces(text, a, b)
        i = j + 1


def pieces(text: str, a: int, b: int) -> Iterator[tuple[int, int, int, int]]:
    """Consecutive islands to the very end of a run, each with twice the longest candidate in common with the next.

    An entity belongs to the island in whose own part it begins; the island holds the longest candidate beyond that.
    """
    if b - a <= 2 * MAX_ISLAND:
        yield a, b, a, b
        return
    at = [m.start() for m in _PIECE.finditer(text, a, b)] + [b]
    i, own, n = 0, a, len(at) - 1
    while True:
        j = min(n, max(bisect_right(at, at[i] + 2 * MAX_ISLAND) - 1, i + 4 * MAX_ATOMS))
        last = b if j == n else at[j - MAX_ATOMS]
        yield at[i], at[j], own, last
        if j == n:
            return
        i, own = j - 2 * MAX_ATOMS, last


_CONTEXT = frozenset("tel telephone phone call mobile fax email mail contact card visa ip host address account".split())


def _edge(c: str) -> str:
    return "^" if not c else "s" if c.isspace() else "d" if c.isdigit() else "a" if c.isalpha() else c


def features(text: str, a: int, b: int, before: str) -> list[str] | None:
    """Features of the whole span, or None if it can't be an entity."""
    s = text[a:b]
    d = _digits(s)
    ats = s.count("@") + len(re.findall(r"[(\[]at[)\]]", s))
    if not (s[0].isalnum() or s[0] in "+(") or not s[-1].isalnum() or (not ats and len(d) < 4):
        return None
    alpha = any(c.isalpha() for c in s)
    if (ats and not alpha) or (not ats and alpha) or (not ats and len(d) > 24):
        return None
    if not ats and not _NUMBER.fullmatch(s):
        return None
    groups = re.findall(r"[0-9]+", s)
    seps = "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", s))))[:8]
    f = [f"n={min(len(d), 20)}", f"at={min(ats, 2)}", f"plus={s[0] == '+'}", f"sep={seps}", f"l={_edge(text[a - 1 : a])}", f"r={_edge(text[b : b + 1])}", f"groups={min(len(groups), 6)}"]
    if ats:
        f += [f"tld={bool(re.search(r'[.)\] ][A-Za-z]{2,12}$', s))}", f"dots={min(s.count('.'), 4)}", f"edges={_edge(text[a - 1 : a])}{_edge(text[b : b + 1])}", f"len={len(s) // 8}"]
    else:
        quad = len(groups) == 4 and s.count(".") == 3
        f += [f"luhn={12 <= len(d) <= 19 and luhn(d)}", f"quad={quad and all(len(g) < 4 and int(g) < 256 for g in groups)}", f"shape={'-'.join(str(len(g)) for g in groups[:6])}"]
    if before in _CONTEXT:
        f.append(f"c={before}")
    return f


#: Fixed examples beside the corpus: numbers that are nobody's, and forms that the patterns miss (in braces, kind first).
EXAMPLES = (
    "on 2024-01-05 10:33 at 3.14", "from 1999-12-31 to 2001-01-01", "version 2.0.1 of", "build 10.4.2.77-rc1", "about 1,234,567,890 people", "ISBN 978-3-16-148410-0", "pages 100-200 and 310-420", "in 1984 2001 2010 2020", "pi is 3.14159265358979", "room 12 34 56 78",
    "score 21-14 25-23", "at 12:30:45 on 05.06.2023", "id 000123456789", "see section 4.2.1.3.5", "from 2019 (12) to 2021", "grid 10 20 30 40 50 60", "population 8 336 817", "commit 3f2504e04f89", "figure 10.1007/978-3-319", "@ 5 pm",
    "call me at {phone:(202) 555-0143} now", "tel {phone:202-555-0143}.", "phone {phone:202 555 0143} or", "mobile {phone:(917) 555-0199}, ask", "fax {phone:415.555.0123} to", "mail {email:ann (at) mail.example.com} today", "email {email:j.doe[at]example.org} please",
)


def examples() -> list[tuple[str, list[Span]]]:
    out = []
    for x in EXAMPLES:
        m = re.search(r"\{([a-z]+):([^}]*)\}", x)
        text = x[: m.start()] + m[2] + x[m.end() :] if m else x
        out.append((text, [(m.start(), m.start() + len(m[2]), m[1])] if m else []))
    return out


class Lattice:
    """Atoms of an island and the candidate segments that end at each of them."""

    def __init__(self, text: str):
        spans = [(m.start(), m.end()) for m in _ATOM.finditer(text)]
        self.n, self.starts, self.ends = len(spans), [a for a, _ in spans], [b for _, b in spans]
        self.into: list[list[tuple[int, list[str]]]] = [[] for _ in range(self.n + 1)]
        last_word = ""
        for i, (a, b) in enumerate(spans):
            first = text[a]
            if first.isalnum() or first in "+(":
                for j in range(i, min(self.n, i + MAX_ATOMS)):
                    if f := features(text, a, spans[j][1], last_word):
                        self.into[j + 1].append((i, f))
            if first.isalpha():
                last_word = text[a:b].lower()


OUT = 0  # label of an atom outside; k + 1 is KINDS[k]
LABELS = range(len(KINDS) + 1)


def _score(w: dict, f: list[str], k: int) -> float:
    return sum(w.get((x, k), 0.0) for x in f) + w.get(("bias", k), 0.0)


def _lse(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs)) if m > -1e300 else -1e308


def decode(lat: Lattice, w: dict) -> list[Span]:
    """Best segmentation: Viterbi over (end, label)."""
    best = [[-1e308] * len(LABELS) for _ in range(lat.n + 1)]
    back: list[list] = [[None] * len(LABELS) for _ in range(lat.n + 1)]
    best[0][OUT] = 0.0
    for e in range(1, lat.n + 1):
        for start, k, s in [(e - 1, OUT, 0.0), *((i, k, _score(w, f, k)) for i, f in lat.into[e] for k in LABELS[1:])]:
            p = max(LABELS, key=lambda q: best[start][q] + w.get(("t", q, k), 0.0))
            v = best[start][p] + w.get(("t", p, k), 0.0) + s
            if v > best[e][k]:
                best[e][k], back[e][k] = v, (start, p)
    out, e = [], lat.n
    k = max(LABELS, key=lambda q: best[e][q]) if e else OUT
    while e:
        start, p = back[e][k]
        if k:
            out.append((lat.starts[start], lat.ends[e - 1], KINDS[k - 1]))
        e, k = start, p
    return out[::-1]


def _gradient(lat: Lattice, gold: list[Span], w: dict) -> dict:
    """Observed less expected features: forward-backward over segments."""
    segs = [[(e - 1, OUT, None, 0.0)] + [(i, k, f, _score(w, f, k)) for i, f in lat.into[e] for k in LABELS[1:]] for e in range(1, lat.n + 1)]
    t = [[w.get(("t", p, k), 0.0) for k in LABELS] for p in LABELS]
    fwd = [[-1e308] * len(LABELS) for _ in range(lat.n + 1)]
    fwd[0][OUT] = 0.0
    for e, seg in enumerate(segs, 1):
        into = defaultdict(list)
        for i, k, _, s in seg:
            into[k].append(s + _lse([fwd[i][p] + t[p][k] for p in LABELS]))
        for k, v in into.items():
            fwd[e][k] = _lse(v)
    bwd = [[-1e308] * len(LABELS) for _ in range(lat.n + 1)]
    bwd[lat.n] = [0.0] * len(LABELS)
    z, g = _lse(fwd[lat.n]), defaultdict(float)
    pend: list[dict] = [defaultdict(list) for _ in range(lat.n + 1)]
    for e in range(lat.n, 0, -1):
        if e < lat.n:
            bwd[e] = [_lse(pend[e][p]) if pend[e][p] else -1e308 for p in LABELS]
        for i, k, f, s in segs[e - 1]:
            for p in LABELS:
                pend[i][p].append(t[p][k] + s + bwd[e][k])
                if (lp := fwd[i][p] + t[p][k] + s + bwd[e][k] - z) > -12:
                    pr = math.exp(min(lp, 0.0))
                    g["t", p, k] -= pr
                    if k:
                        g["bias", k] -= pr
                        for x in f:
                            g[x, k] -= pr
    want = {(a, b): KINDS.index(kind) + 1 for a, b, kind in gold}
    e, prev = 0, OUT
    while e < lat.n:
        hit = next(((j, f, want[lat.starts[e], lat.ends[j - 1]]) for j in range(e + 1, min(lat.n, e + MAX_ATOMS) + 1) if (lat.starts[e], lat.ends[j - 1]) in want for i, f in lat.into[j] if i == e), None)
        j, f, k = hit if hit else (e + 1, [], OUT)
        g["t", prev, k] += 1
        if k:
            g["bias", k] += 1
            for x in f:
                g[x, k] += 1
        e, prev = j, k
    return g


def rewrites(text: str, gold: list[Span]) -> list[tuple[str, list[Span]]]:
    """The island, and a copy in which each entity is written in a way that the patterns miss."""
    out, spans, last = [], [], 0
    for a, b, kind in gold:
        if a < last:
            continue
        s = text[a:b]
        new = {"email": s.replace("@", " (at) "), "phone": s.lstrip("+"), "card": re.sub(r"[ -]", "", s), "ip": s}[kind]
        if kind == "card" and len(new) == 16:
            new = ".".join(new[i : i + 4] for i in range(0, 16, 4))
        out.append(text[last:a])
        at = sum(map(len, out))
        out.append(new)
        spans.append((at, at + len(new), kind))
        last = b
    return [(text, gold)] + ([("".join([*out, text[last:]]), spans)] if spans else [])


def train(rows: list[tuple[str, list[Span]]]) -> dict:
    w: dict = {}
    data = [(Lattice(t), g) for text, gold in rows for t, g in rewrites(text, gold)] + [(Lattice(t), g) for t, g in examples()] * 3 if rows else []
    for epoch in range(EPOCHS):
        rate = STEP / (1 + epoch)
        for lat, gold in data:
            for x, v in _gradient(lat, gold, w).items():
                w[x] = w.get(x, 0.0) * (1 - rate * DECAY) + rate * v
    return w


def _non_overlapping(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def _islands_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h", pa.string()), ("island", pa.string())])
    for batch in batches:
        rows = {}
        for text in column(batch, "text"):
            for a, b, _, _ in islands(text or "") if _TRIGGER.search(text or "") else ():
                rows[hashlib.md5(text[a:b].encode("utf-8", "surrogatepass")).hexdigest()] = text[a:b]
        keep = sorted(rows)[:SAMPLE_ISLANDS]
        yield to_batch(schema, h=keep, island=[rows[h] for h in keep])


def fit(docs: DataFrame, text_col: str = "text") -> dict:
    """Weights from at most SAMPLE_ISLANDS distinct islands, those of the smallest hash: a fixed bound for the driver."""
    texts = docs.select(docs[text_col].alias("text")).where(F.col("text").rlike(_TRIGGER.pattern))
    found = texts.mapInArrow(_islands_of, "h string, island string").groupBy("h").agg(F.first("island").alias("island"))
    rows = found.orderBy("h").limit(SAMPLE_ISLANDS).collect()
    return train([(r.island, _non_overlapping(base_spans(r.island))) for r in rows])


def spans_of(text: str | None, w: dict) -> list[Span]:
    """Base spans and those that the field adds, by start, then kind."""
    if not text or not _TRIGGER.search(text):
        return []
    base = base_spans(text)
    extra: list[Span] = []
    for a, b, own, last in islands(text) if w else ():
        lat = Lattice(text[a:b])
        for s, e, kind in decode(lat, w) if any(lat.into) else ():
            if not own <= a + s < last or (extra and a + s < extra[-1][1]):
                continue
            if not any(x < a + e and y > a + s for x, y, _ in base):
                extra.append((a + s, a + e, "x_" + kind))
    order = {k: i for i, k in enumerate([*KINDS, *("x_" + k for k in KINDS)])}
    return sorted({*base, *extra}, key=lambda s: (s[0], order[s[2]], s[1]))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", weights: dict | None = None) -> DataFrame:
    """(id, spans array<struct<kind,start,end>>), one row per row of ``docs``."""
    w = fit(docs, text_col) if weights is None else weights
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in spans_of(t, w)] for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.list_(span))], names=["id", "spans"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return rows.withColumnRenamed("id", id_col)


def redact_text(text: str | None, w: dict) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans are one."""
    spans = spans_of(text, w)
    if not spans:
        return text
    out, last, i = [], 0, 0
    while i < len(spans):
        s, e, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < e:
            e = max(e, spans[i][1])
            i += 1
        out += [text[last:s], f"[{kind.removeprefix('x_').upper()}]"]
        last = e
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in its text, and the number of characters counted anew."""
    w = fit(docs, text_col)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact_text(t, w))

    may = docs[text_col].rlike(_TRIGGER.pattern)
    out = docs.withColumn(text_col, F.when(may, masked(docs[text_col])).otherwise(docs[text_col]))
    return out.withColumn(chars_col, F.length(text_col).cast("long")) if chars_col in docs.columns else out


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
