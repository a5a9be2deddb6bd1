"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts and items are sequences of normalised words (lower-cased runs of letters and digits). An item of m words matches a
text at a place if some run of words that begins there is within ``allowed(m)`` edits of it: a fifth of m, none below
FUZZY words, which are matched exactly. Over every text slide windows of the size of each item. The CGK random walk reads
a window, padded without end, emits the symbol under its pointer at each of 3 m steps and advances the pointer by a random
bit of (step, symbol): two sequences at a small edit distance meet again after few steps, so their embeddings are at a
small Hamming distance. Bit sampling keeps some random steps of the whole walk, in each of several walks; a window and an
item of equal size that agree on all bits of one repeat are a candidate pair, and their exact edit distance is computed.
Edits grow with the size of an item and walks drift apart, so bits and repeats are chosen for each size: walks over pairs
with exactly the allowed edits (anywhere, in either half, in one burst, substitutions, insertions, deletions and mixtures)
are measured, and the repeats are as many as find MEASURED of every kind. A passage that lost its beginning is found by the
window in which the rest stands at its own place; at the start of a text that window begins before the text, by at most
the allowed edits, and other words stand for what is missing.

Before the walk a lossless screen removes windows: an edit breaks at most two pairs of neighbouring words, so a match with
e edits holds at least m - 1 - 2 e of the item's pairs within m + e words. Only places with enough such pairs are walked.

Items are broadcast in groups of at most ITEM_GROUP words, a fixed bound; more items mean more passes over the texts, each
written before the next begins, so the state of a pass never grows.

Cases: null and empty texts and items match nothing; an item of one word matches every text that holds it; a text that
ends within a window is padded; ties of the distance go to the first window; repeated rows are matched each; repeated item
ids are items of their own; empty tables give an empty result; columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, column, discard, materialize, slices

SIMILARITY = 0.8
FUZZY = 8  # words from which an item may be edited
#: Share of the pairs at the allowed distance that is found, and the measured share that is asked for.
RECALL, MEASURED = 0.95, 0.985
#: Steps that a repeat samples and most repeats, in the order of preference; pairs of each kind that are measured.
PLANS, PAIRS = ((4, 24), (3, 32), (2, 48), (1, 96)), 200
KINDS = ("anywhere", "head", "tail", "burst", "insertions", "deletions", "mixed")
ITEM_GROUP = 1_000_000
TABLE_BYTES, SLOT_BITS = 32 << 20, 22
#: Characters of text that are walked at once: many windows a step, as each step costs some calls.
CHUNK = 4 << 20
#: Words of windows that are laid out at once.
WINDOW_WORDS = 1 << 21
_WORDS = re.compile(r"[^\W_]+")


def text_words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def allowed(m: int) -> int:
    """Edits that an item of m words allows."""
    return int(round(m * (1 - SIMILARITY), 9)) if m >= FUZZY else 0


def walk_bits(code: np.ndarray, salt: np.ndarray, step: int) -> np.ndarray:
    """The random bit of each symbol at a step of the walk with that salt."""
    return (((code ^ salt) * np.uint64(0x9E3779B97F4A7C15 + 2 * step)) >> np.uint64(63)).astype(np.int8)


def edited(x: list, kind: str, e: int, rng: np.random.Generator, new) -> list:
    """``x`` after e edits of a kind; ``new()`` gives symbols to write."""
    m, y = len(x), list(x)
    if kind in ("anywhere", "head", "tail", "burst"):
        lo, hi = {"head": (0, max(m // 2, e)), "tail": (m - max(m // 2, e), m)}.get(kind, (0, m))
        at = int(rng.integers(0, m - e + 1))
        for i in range(at, at + e) if kind == "burst" else lo + rng.choice(hi - lo, e, replace=False):
            y[i] = new()
        return y
    for _ in range(e):
        do = {"insertions": 1, "deletions": 2}.get(kind, int(rng.integers(0, 3)))
        at = int(rng.integers(0, len(y)))
        if do == 0:
            y[at] = new()
        elif do == 1:
            y.insert(at, new())
        else:
            y.pop(at)
    return y


def edited_pairs(m: int, e: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of m random symbols, and the windows of m words that each becomes by exactly e edits: PAIRS of each
    kind; what follows the passage fills the window."""
    new = lambda: rng.integers(0, 1 << 64, dtype=np.uint64)
    a = rng.integers(0, 1 << 64, (len(KINDS) * PAIRS, m), dtype=np.uint64)
    b = [edited(list(x), KINDS[i // PAIRS], e, rng, new) for i, x in enumerate(a)]
    return a, np.array([(y + [new() for _ in range(m - len(y))])[:m] for y in b], dtype=np.uint64)


SALTS = np.random.default_rng(5).integers(0, 1 << 63, max(n for _, n in PLANS), dtype=np.uint64)  # of the walks


@lru_cache(maxsize=None)
def plan_of(m: int, e: int) -> tuple[np.ndarray, ...]:
    """Steps that each repeat samples so that walks over m words find a share of MEASURED of each kind of pairs at e edits.

    Steps are drawn from the whole walk; as the tail of a walk reads padding, which tells nothing, one at least is drawn
    from the steps at which the pointer can't have left the item.
    """
    if not e:
        return (np.arange(1),)
    rng = np.random.default_rng(m)
    a, b = edited_pairs(m, e, rng)
    count = len(a)
    a, b = (np.concatenate([x, np.zeros((count, 1), np.uint64)], axis=1) for x in (a, b))
    rows = np.arange(count)
    picks: dict[int, list[np.ndarray]] = {bits: [] for bits, _ in PLANS}
    found = {bits: np.zeros(count, bool) for bits in picks}
    done: set[int] = set()
    for repeat, salt in enumerate(SALTS, 1):
        at_a, at_b = np.zeros(count, np.int64), np.zeros(count, np.int64)
        same = np.zeros((3 * m, count), bool)
        for step in range(3 * m):
            x, y = a[rows, at_a], b[rows, at_b]
            same[step] = x == y
            at_a = np.minimum(at_a + walk_bits(x, salt, step), m)
            at_b = np.minimum(at_b + walk_bits(y, salt, step), m)
        for bits, limit in PLANS:
            if bits in done or repeat > limit:
                continue
            first = rng.choice(m, 1)
            rest = rng.choice(np.setdiff1d(np.arange(3 * m), first), bits - 1, replace=False)
            picks[bits].append(np.sort(np.concatenate([first, rest])))
            found[bits] |= same[picks[bits][-1]].all(0)
            if found[bits].reshape(len(KINDS), PAIRS).mean(1).min() >= MEASURED:
                done.add(bits)
        best = next((bits for bits, limit in PLANS if bits in done or repeat < limit), PLANS[-1][0])
        if best in done:
            return tuple(picks[best])
    return tuple(picks[PLANS[-1][0]])


def size_class(m: int) -> tuple[int, int]:
    """The least and the greatest size that share a plan: exact below 32, then steps of a sixteenth to a 32nd. The plan is
    for the least size, so that no sampled step is beyond a walk, and for the edits of the greatest."""
    step = 1 << max(m.bit_length() - 5, 0)
    return m // step * step, m // step * step + step - 1


def edit_distances(a: np.ndarray, b: np.ndarray, e: int) -> np.ndarray:
    """Least edit distance of each row of ``a``, m words, to a beginning of the same row of ``b``, m + e words; e + 1 stands
    for more than e. The dynamic program is kept to the diagonals within e, for all rows and diagonals at once."""
    rows, m = a.shape
    far, width = e + 1, 2 * e + 1
    a = np.ascontiguousarray(a.T)
    b = np.concatenate([np.full((e, rows), -1, a.dtype), b.T])  # what stands before a row equals no word
    shift = np.arange(width, dtype=np.int32)[:, None]
    first = np.where(shift < e, far, np.minimum(shift - e, far)).astype(np.int32)
    prev = np.repeat(first, rows, axis=1)
    for i in range(m):
        cur = prev + (b[i : i + width] != a[i])
        np.minimum(cur[:-1], prev[1:] + 1, out=cur[:-1])
        # a word more of b costs one for each diagonal on
        cur -= shift
        np.minimum.accumulate(cur, axis=0, out=cur)
        cur += shift
        prev = np.minimum(cur, far, out=cur)
    return prev.min(axis=0)


class Items:
    """A group of items: vocabulary, pairs of neighbouring words, items by size, and the LSH tables of each size."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.vocab: dict[str, int] = {}
        for _, ws in rows:
            for w in ws:
                self.vocab.setdefault(w, len(self.vocab))
        self.unknown, self.pad = len(self.vocab), len(self.vocab) + 1  # of all other words, and behind a window
        self.symbols = np.array([xxhash.xxh3_64_intdigest(w) for w in self.vocab] + [1, 0], dtype=np.uint64)
        self.sizes: dict[int, dict] = {}
        self.tables: dict[tuple[int, int], np.ndarray] = {}
        pairs: dict[int, np.ndarray] = {}
        for m in sorted({len(ws) for _, ws in rows}):
            group = [(i, ws) for i, ws in rows if len(ws) == m]
            words = np.array([[self.vocab[w] for w in ws] for _, ws in group], dtype=np.int32)
            least, greatest = size_class(m)
            plan = plan_of(least, allowed(greatest))
            entry = {"ids": np.array([i for i, _ in group], dtype=np.int64), "words": words, "plan": plan, "tables": []}
            padded = np.concatenate([words, np.full((len(group), 1), self.pad)], axis=1)
            for repeat, picks in enumerate(plan):
                _, keys, sampled = self.walk(padded, repeat, picks)
                order = np.argsort(keys, kind="stable")
                entry["tables"].append((keys[order], order, sampled))
            self.sizes[m] = entry
            pairs[m] = np.unique(self.pair(words[:, :-1], words[:, 1:]) if m > 1 else words.ravel().astype(np.int64) - (1 << 40))
        self.pairs = np.unique(np.concatenate(list(pairs.values()))) if pairs else np.empty(0, np.int64)
        for m, own in pairs.items():
            self.sizes[m]["mine"] = np.isin(self.pairs, own)
        self.slots = np.zeros(1 << SLOT_BITS, bool)
        self.slots[self.slot(self.pairs)] = True

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, codes: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the pair, place) of the codes that are pairs of some item; most fall through the table of slots."""
        may = np.flatnonzero(self.slots[self.slot(codes)])
        codes, where = codes[may], where[may]
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        hit = self.pairs[at] == codes
        return at[hit], where[hit]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Code of two neighbouring words; a single word has a negative one."""
        return a.astype(np.int64) * (self.pad + 1) + b

    def bits(self, repeat: int, step: int, sym: np.ndarray) -> np.ndarray:
        """The walk's random bit of (repeat, step, symbol), 0 for padding; tables of all symbols are kept up to TABLE_BYTES."""
        table = self.tables.get((repeat, step))
        if table is None:
            if (len(self.tables) + 1) * len(self.symbols) > TABLE_BYTES:
                return walk_bits(self.symbols[sym], SALTS[repeat], step) * (sym != self.pad)
            table = walk_bits(self.symbols, SALTS[repeat], step)
            table[self.pad] = 0
            self.tables[repeat, step] = table
        return table.take(sym)

    def walk(self, windows: np.ndarray, repeat: int, picks: np.ndarray, wanted: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(windows still alive, hash of their sampled symbols, sampled symbols by pick) of CGK walks over the rows of
        ``windows``, whose last column is padding, where a walk stays.

        With ``wanted``, the items' symbols by pick, a window leaves as soon as a sampled symbol is that of no item; its hash
        could equal none of theirs.
        """
        flat, alive, out = windows.ravel(), np.arange(len(windows)), np.zeros(len(windows), np.uint64)
        at, mult, sampled, k, picks = alive * windows.shape[1], np.uint64(0x9E3779B97F4A7C15), [], 0, picks.tolist()
        for step in range(picks[-1] + 1):
            sym = flat.take(at)
            if step == picks[k]:
                sampled.append(sym)
                if wanted is not None:
                    ok = np.zeros(len(self.symbols), bool)
                    ok[wanted[k]] = True
                    keep = np.flatnonzero(ok[sym])
                    alive, at, out, sym = alive[keep], at[keep], out[keep], sym[keep]
                out = out * mult + self.symbols[sym] + np.uint64(step + 1)
                k += 1
                if k == len(picks) or not len(alive):
                    break
            at += self.bits(repeat, step, sym)
        return alive, out, sampled


def places(hits: np.ndarray, owner: np.ndarray, need: int, reach: int) -> np.ndarray:
    """Places from which at least ``need`` of the sorted ``hits`` of the same text lie within ``reach`` words."""
    need = max(need, 1)
    if len(hits) < need:
        return np.empty(0, np.int64)
    first, last = hits[: len(hits) - need + 1], hits[need - 1 :]
    ok = (last - first < reach) & (owner[first] == owner[last])
    lo, hi = np.maximum(last[ok] - reach + 1, 0), first[ok]
    n = hi - lo + 1
    at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.unique(at[owner[at] == np.repeat(owner[hi], n)])


def match(items: Items, docs: list[list[str]]) -> tuple[np.ndarray, ...]:
    """(document, item id, item words, start, edit distance) of verified windows, all starts."""
    nothing = tuple(np.empty(0, np.int64) for _ in range(5))
    get, unknown = items.vocab.get, items.unknown
    lengths = np.array([len(ws) for ws in docs], dtype=np.int64)
    seq = np.array([get(w, unknown) for ws in docs for w in ws], dtype=np.int32)
    if not len(seq) or not items.sizes:
        return nothing
    owner, stops = np.repeat(np.arange(len(docs)), lengths), np.cumsum(lengths)
    offsets = stops - lengths
    # neighbouring words that some item has, once for all sizes; single words only where an item is one
    known = seq != unknown
    where = np.flatnonzero(known[:-1] & known[1:])
    at, where = items.find(items.pair(seq[where], seq[where + 1]), where)
    inside = owner[where] == owner[np.minimum(where + 1, len(seq) - 1)]
    at, where = at[inside], where[inside]
    if 1 in items.sizes:
        single = np.flatnonzero(known)
        at1, where1 = items.find(seq[single].astype(np.int64) - (1 << 40), single)
        at, where = np.concatenate([at, at1]), np.concatenate([where, where1])
        order = np.argsort(where, kind="stable")
        at, where = at[order], where[order]
    found: list[list[np.ndarray]] = []
    for m, group in items.sizes.items():
        e = allowed(m)
        starts = places(where[group["mine"][at]], owner, m - 1 - 2 * e, max(m + e - 1, 1))
        if not len(starts):
            continue
        # windows that begin up to e words before their text, for passages that lost their beginning there
        heads = np.flatnonzero(starts == offsets[owner[starts]])
        origin = np.concatenate([np.arange(len(starts)), np.repeat(heads, e)])
        lead = np.concatenate([np.zeros(len(starts), np.int64), np.tile(np.arange(1, e + 1), len(heads))])
        begins = starts[origin]
        firsts, ends, pairs = begins - lead, np.minimum(begins - lead + m, stops[owner[begins]]), []
        block = max(WINDOW_WORDS // (m + 1), 1)
        for i in range(0, len(firsts), block):
            read = firsts[i : i + block, None] + np.arange(m + 1)
            windows = np.where(read < ends[i : i + block, None], seq[np.clip(read, 0, len(seq) - 1)], items.pad)
            windows[read < begins[i : i + block, None]] = unknown
            for repeat, (picks, (keys, order, sampled)) in enumerate(zip(group["plan"], group["tables"])):
                alive, own, _ = items.walk(windows, repeat, picks, sampled)
                lo, hi = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
                w = np.flatnonzero(hi > lo)
                if len(w):
                    n = hi[w] - lo[w]
                    item = order[np.repeat(lo[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    pairs.append(origin[np.repeat(alive[w] + i, n)] * len(group["ids"]) + item)
        if not pairs:
            continue
        pair = np.unique(np.concatenate(pairs))
        for i in range(0, len(pair), 20_000):
            w, item = pair[i : i + 20_000] // len(group["ids"]), pair[i : i + 20_000] % len(group["ids"])
            read = starts[w][:, None] + np.arange(m + e)
            windows = np.where(read < stops[owner[starts[w]]][:, None], seq[np.minimum(read, len(seq) - 1)], items.pad)
            d = edit_distances(group["words"][item], windows, e)
            ok = d <= e
            w, item, d = w[ok], item[ok], d[ok]
            doc = owner[starts[w]]
            found.append([doc, group["ids"][item], np.full(len(w), m), starts[w] - offsets[doc], d])
    if not found:
        return nothing
    return tuple(np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(5))


def item_groups(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in groups of at most ITEM_GROUP words, streamed to the driver one group at a time."""
    group, size = [], 0
    for r in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).toLocalIterator():
        ws = text_words(r[1])
        if not ws:
            continue
        if group and size + len(ws) > ITEM_GROUP:
            yield group
            group, size = [], 0
        group.append((int(r[0]), ws))
        size += len(ws)
    if group:
        yield group


def find_matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, columns of ``keep``, matches array<struct<item_id,item_words,start,distance>>), one row per row of ``docs``.

    ``matches`` has the best window of each matching item; ``start`` counts words.
    """
    keep = {id_col: docs[id_col]} if keep is None else keep
    rows = docs.select(*[c.alias(k) for k, c in keep.items()], docs[text_col].alias("_cgk_text"))
    spark = docs.sparkSession
    struct = pa.struct([("item_id", pa.int64()), ("item_words", pa.int32()), ("start", pa.int32()), ("distance", pa.int32())])
    out = last = rows.withColumn("matches", F.array().cast("array<struct<item_id:bigint,item_words:int,start:int,distance:int>>"))
    shared = None
    for group in item_groups(benchmark, item_id, item_text):
        if shared is not None:  # one group is live at a time
            done = materialize(out, "cgk-pass")
            shared.destroy()
            discard(last)
            out = last = done
        shared = spark.sparkContext.broadcast(Items(group))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = column(batch, "_cgk_text")
                for a, b in slices(texts, CHUNK):
                    best: dict[tuple[int, int], tuple] = {}
                    for doc, item, m, start, d in zip(*(x.tolist() for x in match(shared.value, [text_words(t) for t in texts[a:b]]))):
                        if (doc, item) not in best or (d, start) < best[doc, item]:
                            best[doc, item] = (d, start, m)
                    lists: list[list] = [list(x) for x in batch.column(batch.num_columns - 1).slice(a, b - a).to_pylist()]
                    for (doc, item), (d, start, m) in sorted(best.items()):
                        lists[doc].append({"item_id": item, "item_words": m, "start": start, "distance": d})
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lists, pa.list_(struct))], names=part.schema.names)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
        out = out.mapInArrow(bounded(run), fields)
    return out.drop("_cgk_text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **cols) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, all columns kept."""
    alias = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    found = find_matches(docs, benchmark, keep={a: docs[c] for c, a in alias.items()}, **cols)
    return found.where(F.size("matches") == 0).select(*[F.col(a).alias(c) for c, a in alias.items()])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, item_words, start, distance): one row a document and item that it holds."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_matches(docs, benchmark).where(F.size("matches") > 0)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
