"""Language-model scoring by a probabilistic suffix tree over words.

The tree's nodes are contexts of words, of any length up to MAX_ORDER. It grows by order: a context is tried where its
suffix is a node and its own count is known, and becomes a node if its next-word distribution diverges enough from that of
its suffix, both by occurrence (DIVERGENCE nats) and in all: the gain in log likelihood must pay half the logarithm of its
count for each next word that it gives own mass to (the Bayesian information criterion), so few observations don't make a
node. Growth ends at the order at which no context passes. A node's distribution gives own mass to the next words seen
MIN_COUNT times after it and hands the rest, with a smoothing weight, to its suffix; at the root stands the add-one
unigram with one slot for unknown words, so each distribution sums to one. A text's score adds log10 of the probability
of each word, and of the end, given the longest suffix of the words before that is a node. The boundary before the first
word is a context too.

All counts are sums over every training row, and MIN_COUNT is absolute, so the tree grows with the corpus. A run of words
(a gram) has as key the mix of the keys of its prefix and its suffix, so the context of a transition is its prefix, and
what it backs off to is its suffix. A task sends its counts in one message a bucket of the key space; the number of buckets
follows the size of the corpus, so a bucket's size doesn't. A message has the words of its grams, from which the keys follow:
two or five bytes for each of the OFTEN most frequent words, which are broadcast, and the hash of any other. So the bytes of
a gram don't grow with the number of buckets. In logarithms each order adds a term, so a
text's score is a sum over its grams of one value each. Texts are turned into hashes once, in chunks that are written. To
score, a chunk sends the keys that it asks for to their buckets of the key space, where the values are, and gets values
back: two shuffles of arrays, whatever the order of the tree. Three things are broadcast, all of bounded size: the OFTEN
most frequent words with their counts and grams with a share of P_TABLE of all tokens, at most 1/P_TABLE an order, which
only saves their shuffle; and bit sets of keys, which let a task drop grams that can't be in a table. They err to the safe side only, so neither changes a score.

Cases: a null or empty text is its end alone; repeated rows and ids are scored row by row; with nothing to train on,
every probability is that of an empty unigram, 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, bounded, broadcasting, column, crc_mod, discard, materialize, slices, words

#: Share of all tokens from which a gram is broadcast.
P_TABLE = 5e-7
MAX_ORDER, MIN_COUNT = 4, 4
#: Smoothing weight of the suffix, and least divergence in nats an occurrence that retains a context.
ALPHA, DIVERGENCE = 4.0, 0.02
#: Entries that a task counts before it emits them, and bytes of text for which a bucket of the key space is made.
FLUSH, BUCKET_BYTES = 2_000_000, 1 << 24
#: Upper bits of the keys that a task merges and packs at a time.
RANGE_BITS = 4
#: Frequent words that are broadcast at most; the code of all others; codes from MORE on take three bytes more.
OFTEN, RARE, MORE = 1_000_000, (1 << 24) - 1, (1 << 16) - 1
#: Buckets of counts that make one of values: fewer of these leave fewer partial sums of a text.
WIDER = 4
#: Keys of one message to a bucket, so a batch of messages (10,000 of them) is small, and the kinds of rows that meet there.
MESSAGE = 256
WORDS, GRAMS, ASK_WORDS, ASK_GRAMS, OWN = range(5)
#: Bits of a bit set for each key and at most, and bits of a segment of it.
SCREEN_PER_KEY, SCREEN_BITS, SEGMENT = 16, 1 << 29, 1 << 16
END = b""  # the end of a text as a token; no word is empty


def word_hashes() -> Remembered:
    """64-bit hash of each word, as the engine's xxhash64 has it."""
    return Remembered(lambda w: xxhash.xxh64_intdigest(w, 42))


END_HASH = np.uint64(xxhash.xxh64_intdigest(END, 42))


def encode(texts: list, hashes: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an END before the first text and after each; the length of each text with its end."""
    tokens, out = [words(t) for t in texts], [int(END_HASH)]
    for ws in tokens:
        out.extend([hashes[w] for w in ws])
        out.append(int(END_HASH))
    return np.array(out, dtype=np.uint64), np.array([len(ws) + 1 for ws in tokens], dtype=np.int64)


def written(rows: DataFrame) -> DataFrame:
    """(chunk, id array, held_out array, length array, size, tokens binary) of rows (id, held_out, text binary).

    A chunk is about CHUNK_CHARS of text; ``tokens`` are the packed hashes of its texts, an END after each; ``size`` is the
    bytes of those that are not held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            texts, held = column(batch, "text"), column(batch, "held_out")
            for a, b in slices(texts):
                x, lengths = encode(texts[a:b], hashes)
                size = sum(len(t) for t, h in zip(texts[a:b], held[a:b]) if t and not h)
                lists = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), v) for v in (batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(lengths))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([size], pa.int64()), pa.array([pack(x[1:])], pa.binary())], names=["id", "held_out", "length", "size", "tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    chunks = rows.mapInArrow(bounded(run), f"id array<{kind}>, held_out array<boolean>, length array<long>, size long, tokens binary")
    return materialize(chunks.withColumn("chunk", F.monotonically_increasing_id()), "pst-tokens", "zstd")


def unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct token hashes of a chunk, the index into them of each token with an END before them, lengths of its texts,
    and which of these are held out."""
    get = lambda name: batch.column(batch.schema.get_field_index(name))[i]
    table, code = unpack(get("tokens").as_py())
    return table, np.concatenate([code[-1:], code]), *(get(c).values.to_numpy(zero_copy_only=False) for c in ("length", "held_out"))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of a gram from those of its prefix and its suffix."""
    x = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grams(x: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ok, keys, keys of contexts, keys of suffixes) of the runs of 2, 3 .. ``order`` + 1 tokens, by their first token.

    ``ok`` tells grams from other runs: only the first token of a gram and its last may be an END.
    """
    inner, ok, key = x != END_HASH, np.ones(len(x), bool), x
    for j in range(order):
        ctx, sub = key[:-1], key[1:]
        ok = ok[:-1] & inner[j:-1] if j else ok[:-1]
        key = mix(ctx, sub)
        yield ok, key, ctx, sub


class Screen:
    """A bit set of keys, two bits each, of bounded size: has() is True for each of its keys and for some others."""

    def __init__(self, keys: DataFrame):
        rows, bits = keys.count(), SEGMENT
        while bits < min(SCREEN_PER_KEY * rows, SCREEN_BITS):
            bits *= 2
        self.mask, self.bytes = np.uint64(bits - 1), np.zeros(bits // 8, np.uint8)
        mask = self.mask

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(bits // 8, np.uint8)
            for batch in batches:
                key = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for at in (key & mask, (key >> SHIFT) & mask):
                    np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            yield from rows_of(own)

        def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(bits // 8, np.uint8)
            for batch in batches:
                for segment, part in zip(column(batch, "segment"), column(batch, "bits")):
                    own[segment * size : (segment + 1) * size] |= np.frombuffer(part, np.uint8)
            yield from rows_of(own)

        def rows_of(own: np.ndarray) -> Iterator[pa.RecordBatch]:
            parts = own.reshape(-1, size)
            some = np.flatnonzero(parts.any(1))
            for i in range(0, max(len(some), 1), 64):
                yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 64], pa.int64()), pa.array([parts[j].tobytes() for j in some[i : i + 64]], pa.binary())], names=["segment", "bits"])

        size = SEGMENT // 8
        sent = keys.select("key").mapInArrow(bounded(run), "segment long, bits binary").repartition("segment").mapInArrow(bounded(either), "segment long, bits binary")
        for batch in sent.toArrow().to_batches():  # one job, whatever the number of partitions; SCREEN_BITS at most
            for segment, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                self.bytes[segment * size : (segment + 1) * size] |= np.frombuffer(part.as_buffer(), np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = self._bit(keys & self.mask)
        some = np.flatnonzero(out)
        out[some] = self._bit((keys[some] >> SHIFT) & self.mask)
        return out

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


SHIFT = np.uint64(32)  # keys are uniform, so their upper bits are a second hash


def pack(v: np.ndarray) -> bytes:
    """Keys as bytes: a table of the distinct ones and two bytes for each where that is shorter."""
    table, code = np.unique(v, return_inverse=True)
    if len(table) <= 1 << 16 and 8 * len(table) < 6 * len(v):
        return len(table).to_bytes(4, "little") + table.tobytes() + code.astype(np.uint16).tobytes()
    return bytes(4) + v.tobytes()


def unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the index into them of each."""
    size = int.from_bytes(b[:4], "little")
    if not size:
        return np.unique(np.frombuffer(b, np.uint64, offset=4), return_inverse=True)
    return np.frombuffer(b, np.uint64, size, 4), np.frombuffer(b, np.uint16, offset=4 + 8 * size)


def narrow(v: np.ndarray) -> bytes:
    """Integers of at least 0 in as few bytes each as the largest needs; a byte before them says how many."""
    kind = np.min_scalar_type(int(v.max()) if len(v) else 0)
    return bytes([kind.itemsize]) + v.astype(kind).tobytes()


def wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"u{b[0]}", offset=1)


def squeeze(codes: np.ndarray, n: np.ndarray) -> bytes:
    """Codes of the words of grams (a row a place) and counts, packed by zstd; low and high bytes of codes lie apart."""
    apart = lambda v, kind, used: v.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize)[:, :used].T.tobytes()
    raw = apart(np.minimum(codes, MORE).ravel(), "<u2", 2) + apart(codes[codes >= MORE], "<u4", 3) + narrow(n)
    return codes.shape[1].to_bytes(4, "little") + len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(b: bytes, places: int) -> tuple[np.ndarray, np.ndarray]:
    size, length = int.from_bytes(b[:4], "little"), int.from_bytes(b[4:8], "little")
    raw = pa.decompress(b[8:], decompressed_size=length, codec="zstd", asbytes=True)
    low, high = np.frombuffer(raw, np.uint8, 2 * places * size).reshape(2, -1).astype(np.uint32)
    codes = low | high << np.uint32(8)
    more = np.flatnonzero(codes == MORE)
    low, mid, high = np.frombuffer(raw, np.uint8, 3 * len(more), 2 * len(codes)).reshape(3, -1).astype(np.uint32)
    codes[more] = low | mid << np.uint32(8) | high << np.uint32(16)
    return codes.reshape(places, size), wide(raw[2 * len(codes) + 3 * len(more) :]).astype(np.int64)


def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sums of [key, payload .., n] arrays by key, sorted by key."""
    key, *payload, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(starts(key))
    return [key[first], *[p[order[first]] for p in payload], np.add.reduceat(n[order], first, dtype=n.dtype) if len(first) else n]


def summed_from(parts: list[list[np.ndarray]], least: int) -> list[np.ndarray]:
    """``merged`` of unsorted parts without the keys whose sum is below ``least``; empties ``parts``, and copies the payload of the others only."""
    keys, *payload, n = zip(*parts)
    parts.clear()
    key, n = np.concatenate(keys), np.concatenate(n)
    del keys
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(starts(key))
    n = np.add.reduceat(n[order], first) if len(first) else n
    ok = n >= least
    first, n = first[ok], n[ok]
    key, at = key[first], order[first]
    del order
    return [key, *[np.concatenate(p)[at] for p in payload], n]


def starts(v: np.ndarray) -> np.ndarray:
    """True where a run of equal values begins."""
    return np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.empty(0, bool)


def bucket_bits(buckets: int) -> int:
    return max(buckets - 1, 1).bit_length()


class Frequent:
    """At most OFTEN words, those of the greatest counts, the most frequent first: hashes, counts, and their Index; ``rest``
    has the other words."""

    def __init__(self, vocab: DataFrame):
        level, least, room = F.floor(8 * F.log2("n")), None, OFTEN
        for r in sorted(vocab.groupBy(level.alias("level")).count().collect(), reverse=True):  # a row an eighth of a doubling
            room -= r["count"]
            if room < 0:
                break
            least = r["level"]
        here = F.lit(False) if least is None else level >= least
        t = vocab.where(here).select("key", "n").toArrow()
        key, n = (t.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
        by = np.lexsort((key, -n))
        self.hashes, self.n, self.rest = key[by].view(np.uint64), n[by], vocab.where(~here)
        self.index = Index(self.hashes)


def count(chunks: DataFrame, order: int, buckets: int, screens=None, often=None) -> DataFrame:
    """(key, n) of all words of texts that are not held out for order 0; (key, ctx, sub, n) of the grams of ``order`` words and the next that occur
    MIN_COUNT times and have their prefix in the first of the broadcast ``screens`` and their suffix in the second; ``often``
    is the broadcast (hashes, Index) of the most frequent words."""
    bits = np.uint64(bucket_bits(buckets))

    def found(x: np.ndarray) -> list[np.ndarray]:
        """[key, first token, n] of the grams of a chunk, sorted by key."""
        for ok, key, ctx, sub in grams(x, order):  # noqa: B007
            pass
        at = np.flatnonzero(ok)
        at = at[screens.value[1].has(sub[at])]
        at = at[screens.value[0].has(ctx[at])]
        key = key[at]
        by = np.argsort(key)
        key = key[by]
        first = np.flatnonzero(starts(key))
        return [key[first], at[by[first]].astype(np.uint32), np.diff(first, append=len(key)).astype(np.uint32)]

    def packed(key: np.ndarray, at: np.ndarray, n: np.ndarray, code: np.ndarray, rare: np.ndarray) -> pa.RecordBatch:
        """A row a bucket; inside, sorted by the first words, which compresses well. A code from RARE on is a place in ``rare``."""
        own = key >> (np.uint64(64) - bits)
        by = own
        for j in range(min(order + 1, 3)):  # 16 bits of the bucket and of each of three words
            by = by << np.uint64(16) | np.minimum(code[at + np.uint32(j)], MORE)
        by = np.argsort(by)
        own, at, n = own[by], at[by], n[by]
        start, to = runs(own)
        rows = []
        for a, b in zip(start, to):
            codes = code[at[a:b] + np.arange(order + 1, dtype=np.uint32)[:, None]]
            rows.append((int(own[a]), squeeze(np.minimum(codes, RARE), n[a:b]), rare[codes[codes >= RARE] - RARE].tobytes()))
        return messages(rows)

    def packed_words(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        own = key >> (np.uint64(64) - bits)  # the keys are sorted
        return messages([(int(own[a]), narrow(n[a:b]), key[a:b].tobytes()) for a, b in zip(*runs(own))])

    def messages(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "n", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = min(bits, np.uint64(RANGE_BITS))  # a range of keys is one bucket or more
        edges = np.arange(1, 1 << int(high), dtype=np.uint64) << (np.uint64(64) - high)

        def nothing() -> tuple[list[list], int, bytearray, list[np.ndarray], int]:
            """Parts of each range of keys and their entries; codes of the tokens, hashes of those that have none, and their number."""
            return [[] for _ in range(len(edges) + 1)], 0, bytearray(), [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            code, hashes = np.frombuffer(codes, np.uint32), np.concatenate(rare) if rare else np.empty(0, np.uint64)
            for own in parts:
                sums = merged(own)
                own.clear()
                yield packed(*sums, code, hashes) if order else packed_words(*sums)

        parts, size, codes, rare, rares = nothing()
        for batch in batches:
            for i in range(batch.num_rows):
                table, code, lengths, held = unpacked(batch, i)
                code = code[np.concatenate([[True], np.repeat(~held.astype(bool), lengths)])]
                if order:
                    key, at, n = found(table[code])
                    got = [key, at + np.uint32(len(codes) // 4), n]
                    at = often.value[1].find(table)
                    new = np.flatnonzero(at < 0)
                    at[new] = RARE + rares + np.arange(len(new))
                    rare.append(table[new])
                    rares += len(new)
                    codes += at.astype(np.uint32)[code].data
                else:
                    n = np.bincount(code[1:], minlength=len(table))
                    got = [table[n > 0], n[n > 0]]
                cuts = [0, *np.searchsorted(got[0], edges), len(got[0])]
                for own, a, b in zip(parts, cuts, cuts[1:]):
                    own.append([c[a:b] for c in got])
                size += len(got[0])
                full = len(codes) // 4 > 8 * FLUSH
                if size > 2 * FLUSH or full:
                    if not full:
                        for own in parts:
                            own[:] = [merged(own)]
                        size = sum(len(own[0][0]) for own in parts)
                    if size > FLUSH or full:
                        yield from flushed()
                        parts, size, codes, rare, rares = nothing()
        if parts[0]:
            yield from flushed()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                b, n, keys = (batch.column(c)[i].as_py() for c in range(3))
                if b != bucket and parts:
                    yield from rows_of(parts)
                    parts = []
                bucket, keys = b, np.frombuffer(keys, np.uint64)
                if order:
                    codes, n = expand(n, order + 1)
                    rare = codes == RARE
                    hashes = often.value[0]
                    level = hashes[np.where(rare, 0, codes)] if len(hashes) else np.zeros(codes.shape, np.uint64)
                    level[rare] = keys
                    while len(level) > 2:
                        level = mix(level[:-1], level[1:])
                    parts.append([mix(*level), *level, n])
                else:
                    parts.append([keys, wide(n).astype(np.int64)])
        if parts:
            yield from rows_of(parts)

    def rows_of(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        *keys, n = summed_from(parts, MIN_COUNT if order else 1)
        keys = [k.view(np.int64) for k in keys]
        for i in range(0, len(n), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in (*keys, n)], names=["key", *(("ctx", "sub") if order else ()), "n"])

    dealt = chunks.select("tokens", "length", "held_out").mapInArrow(bounded(run), "bucket int, n binary, keys binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(bounded(summed), f"key long, {'ctx long, sub long, ' if order else ''}n long")


class Index:
    """Positions of distinct keys: they are uniform, so the upper bits of a key tell about where it stands among the sorted ones."""

    def __init__(self, keys: np.ndarray):
        bits = max(len(keys), 1).bit_length()
        self.shift, self.at = np.uint64(64 - bits), np.argsort(keys).astype(np.int32)
        self.keys = np.concatenate([keys[self.at], [np.uint64(2**64 - 1)]])
        self.first = np.searchsorted(self.keys[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.at = np.append(self.at, np.int32(-1))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Position of each wanted key among ``keys`` as they were given, or -1."""
        i = self.first[(wanted >> self.shift).astype(np.int64)]
        below = np.flatnonzero(self.keys[i] < wanted)
        while len(below):
            i[below] += 1
            below = below[self.keys[i[below]] < wanted[below]]
        return np.where(self.keys[i] == wanted, self.at[i], -1)


def lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted key in sorted ``keys``, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


class Model:
    """What is broadcast for scoring: frequent words, frequent grams with their values, a screen of all grams with a value."""

    def __init__(self, frequent: Frequent, total: int, distinct: int, values: pa.Table, screen: Screen, order: int):
        def sorted_columns(t: pa.Table, *names: str) -> list[np.ndarray]:
            key, *rest = (t.column(c).to_numpy() for c in ("key", *names))
            key = key.astype(np.int64).view(np.uint64)
            at = np.argsort(key)
            return [key[at], *[r[at] for r in rest]]

        self.hashes = frequent.hashes
        self.keys, raised, weight = sorted_columns(values, "raised", "weight")
        self.raised, self.weight, self.screen, self.total, self.distinct, self.order = raised.astype(float), weight.astype(float), screen, total, distinct, order
        self.word, self.gram = frequent.index, Index(self.keys)
        self.logs = np.log10(frequent.n + 1.0)
        self.root = self.logs - math.log10(total + distinct + 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token but the first, by what is broadcast, for token hashes; a word that is not
        broadcast lacks its root probability."""
        i = self.word.find(x)
        out = np.where(i >= 0, self.root[np.maximum(i, 0)], 0.0) if len(self.root) else np.zeros(len(x))
        for j, (ok, key, ctx, _) in enumerate(grams(x, self.order), 1):
            for values, wanted in ((self.raised, key), (self.weight, ctx)):
                i = self.gram.find(wanted)
                hit = np.flatnonzero((i >= 0) & ok)
                out[hit + j] += values[i[hit]]
        return out[1:]


def grow(chunks: DataFrame, vocab: DataFrame, norm: float, buckets: int, often) -> tuple[DataFrame | None, int, list[DataFrame]]:
    """(values (key, n, raised, weight) of all nodes and their transitions, depth of the tree, the written tables that the
    values read); None for a bare root."""
    spark, values, depth, read, last = chunks.sparkSession, None, 0, [], None
    counted = vocab.where(F.col("n") >= MIN_COUNT)
    live = counted.select("key", (F.log10(F.col("n") + 1.0) - F.lit(norm)).alias("s"))  # log10 probability in the order below
    for order in range(1, MAX_ORDER + 1):
        with broadcasting(spark, (Screen(counted), Screen(live))) as screens:
            found = count(chunks, order, buckets, screens, often)
            t = materialize(found.join(live.select(F.col("key").alias("sub"), F.col("s").alias("below")), "sub").select("key", "ctx", "n", "below"), f"pst-order{order}")
        seen = counted.select(F.col("key").alias("ctx"), F.col("n").alias("seen"))
        rest = F.greatest(F.col("seen") - F.col("own"), F.lit(0))
        contexts = t.groupBy("ctx").agg(F.sum("n").alias("own")).join(seen, "ctx")
        contexts = contexts.select("ctx", "seen", rest.cast("double").alias("rest"), F.log10((ALPHA + rest) / (F.col("seen") + ALPHA)).alias("weight"))
        logp = F.log10((F.col("n") + (ALPHA + F.col("rest")) * F.pow(F.lit(10.0), "below")) / (F.col("seen") + ALPHA))
        gain = t.join(contexts, "ctx").groupBy("ctx").agg(F.sum(F.col("n") * (logp - F.col("below"))).alias("gain"), F.count(F.lit(1)).alias("k"), *[F.first(c).alias(c) for c in ("seen", "rest", "weight")])
        nats = (F.col("gain") + F.col("rest") * F.col("weight")) * math.log(10)
        kept = (nats >= DIVERGENCE * F.col("seen")) & (nats >= 0.5 * F.col("k") * F.log("seen"))
        nodes = materialize(gain.where(kept).select("ctx", "seen", "rest", "weight"), f"pst-nodes{order}")
        own = t.join(nodes, "ctx").select("key", "n", logp.alias("s"), (logp - F.col("below") - F.col("weight")).alias("raised"))
        own = materialize(own, f"pst-live{order}")
        if last is not None:
            discard(last)
        last = t
        if not own.take(1):
            discard(nodes, own)
            break
        depth = order
        read += [nodes, own]
        counted, live = t.select("key", "n"), own.select("key", "s")
        new = own.select("key", "n", "raised", F.lit(0.0).alias("weight")).unionByName(nodes.select(F.col("ctx").alias("key"), F.col("seen").alias("n"), F.lit(0.0).alias("raised"), "weight"))
        values = new if values is None else values.unionByName(new)
        found = contexts = gain = None
        spark.sparkContext._jvm.System.gc()  # the context cleaner then deletes the shuffle files of finished steps
    if last is not None:
        discard(last)
    return values, depth, read


def learn(train: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """``fit`` for rows (text binary)."""
    return fit(written(train.select(F.lit(0).alias("id"), F.lit(False).alias("held_out"), "text")))[:3]


def fit(chunks: DataFrame) -> tuple[Model, DataFrame, DataFrame, int]:
    """(model, words (key, n) and values (key, value) that are not broadcast, number of buckets of values) of ``written`` texts."""
    size = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(8, size // BUCKET_BYTES)
    vocab = materialize(count(chunks, 0, buckets), "pst-vocab")
    total, distinct = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(1.0, P_TABLE * total)
    frequent = Frequent(vocab)
    with broadcasting(chunks.sparkSession, (frequent.hashes, frequent.index)) as often:
        values, depth, read = grow(chunks, vocab, math.log10(total + distinct + 1), buckets, often)
    if values is None:
        values = vocab.limit(0).select("key", "n", F.lit(0.0).alias("raised"), F.lit(0.0).alias("weight"))
    values = materialize(values.groupBy("key").agg(F.max("n").alias("n"), F.sum("raised").alias("raised"), F.sum("weight").alias("weight")), "pst-values")
    discard(*read)
    rare = values.where(F.col("n") < least).select("key", (F.col("raised") + F.col("weight")).alias("value"))
    model = Model(frequent, total, distinct, values.where(F.col("n") >= least).toArrow(), Screen(values), depth)
    return model, frequent.rest, rare, max(8, buckets // WIDER)


def asked(chunks: DataFrame, shared, buckets: int) -> DataFrame:
    """(bucket, kind, key, at, keys) messages: of each chunk (``key``) the hashes of words and the keys of grams that are not
    broadcast, with the text that each counts for; and one OWN message with what the broadcast gives its texts."""
    bits = np.uint64(bucket_bits(buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        both = m.raised + m.weight
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = batch.column(batch.schema.get_field_index("chunk"))[i].as_py()
                table, code, lengths, _ = unpacked(batch, i)
                texts, owner = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
                x = table[code]
                ids = m.word.find(table)[code[1:]]
                known = ids >= 0
                extra = np.zeros(texts)
                asks = [(ASK_WORDS, owner[~known], x[1:][~known])]

                def gathered(may: np.ndarray, key: np.ndarray, at: np.ndarray, j: int) -> None:
                    nonlocal extra
                    who, key, at = owner[may + max(j - 1, 0)], key[may], at[may]  # noqa: B023
                    hit = at >= 0
                    if len(both):
                        extra += np.bincount(who[hit], weights=both[at[hit]], minlength=texts)  # noqa: B023
                    asks.append((ASK_GRAMS, who[~hit], key[~hit]))  # noqa: B023

                # a gram counts for the text of its end; a word, or the boundary, for the text of the token after it
                gathered(np.flatnonzero(m.screen.has(table)[code[:-1]]), x, m.gram.find(table)[code], 0)
                may = np.ones(len(x), bool)
                for j, (ok, key, _, _) in enumerate(grams(x, m.order), 1):
                    # a gram of three words or more has a value only if its suffix has one
                    try_ = np.flatnonzero(ok & may[1:] if j > 1 else ok)
                    try_ = try_[m.screen.has(key[try_])]
                    at = np.full(len(key), -1)
                    at[try_] = m.gram.find(key[try_])
                    gathered(try_, key, at, j)
                    may = np.zeros(len(key), bool)
                    may[try_] = True
                base = np.bincount(owner[known], weights=m.logs[ids[known]], minlength=texts) if len(m.logs) else np.zeros(texts)
                own = np.concatenate([np.bincount(owner[known], minlength=texts).astype(float), base, extra])
                rows = [(chunk & 7, OWN, own.tobytes(), b"")]
                for kind in (ASK_WORDS, ASK_GRAMS):
                    who, key = (np.concatenate([a[j] for a in asks if a[0] == kind]) for j in (1, 2))
                    to = (key >> (np.uint64(64) - bits)).astype(np.int64)
                    order = np.lexsort((who, to))
                    who, key, to = who[order], key[order], to[order]
                    for start, end in zip(*runs(to)):
                        for j in range(start, end, MESSAGE):
                            rows.append((int(to[j]), kind, narrow(who[j : min(j + MESSAGE, end)]), key[j : min(j + MESSAGE, end)].tobytes()))
                for j in range(0, len(rows), MESSAGE):
                    to, kind, at, keys = zip(*rows[j : j + MESSAGE])
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(kind, pa.int32()), pa.array([chunk] * len(to), pa.int64()), pa.array(at, pa.binary()), pa.array(keys, pa.binary())], names=["bucket", "kind", "key", "at", "keys"])

    return chunks.select("chunk", "tokens", "length", "held_out").mapInArrow(bounded(run), "bucket int, kind int, key long, at binary, keys binary")


def runs(*columns: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of equal rows."""
    size = len(columns[0])
    if not size:
        return [], []
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    starts = np.flatnonzero(new).tolist()
    return starts, [*starts[1:], size]


def answered(messages: DataFrame, vocab: DataFrame, values: DataFrame, buckets: int) -> DataFrame:
    """(chunk, kind, at, value) for each message: the texts and counts or values of those of its keys that have one; OWN as it is."""
    bits = np.uint64(bucket_bits(buckets))

    def tables(kind: int) -> Callable:
        """Messages (bucket, kind, 0, values, keys) of rows (key, value)."""

        def packed(key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(key)
            key, value = key[order], value[order]
            to = (key >> (np.uint64(64) - bits)).astype(np.int64)
            rows = [(int(to[a]), kind, 0, narrow(value[a:b]) if kind == WORDS else value[a:b].tobytes(), key[a:b].tobytes()) for a, b in zip(*runs(to))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "kind", "key", "at", "keys"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, size = [], 0
            for batch in batches:
                parts.append([batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)])
                size += batch.num_rows
                if size > FLUSH:
                    yield packed(*(np.concatenate(p) for p in zip(*parts)))
                    parts, size = [], 0
            if size:
                yield packed(*(np.concatenate(p) for p in zip(*parts)))

        return bounded(run)

    both = messages
    for kind, t, value in ((WORDS, vocab, "n"), (GRAMS, values, "value")):
        both = both.unionByName(t.select("key", value).mapInArrow(tables(kind), messages.schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables = None, {}
        for batch in batches:
            get = {c: batch.column(batch.schema.get_field_index(c)) for c in ("bucket", "kind", "key", "at", "keys")}
            bucket, kind, key = (get[c].to_numpy(zero_copy_only=False) for c in ("bucket", "kind", "key"))
            rows = []
            for a, b in zip(*runs(bucket, kind)):
                if bucket[a] != now:
                    now, tables = bucket[a], {WORDS: [], GRAMS: []}
                if kind[a] <= GRAMS:
                    for i in range(a, b):
                        v = get["at"][i].as_py()
                        tables[kind[a]].append([np.frombuffer(get["keys"][i].as_py(), np.uint64), wide(v) if kind[a] == WORDS else np.frombuffer(v, float)])
                    continue
                if kind[a] == OWN:
                    rows += [(int(key[i]), OWN, get["at"][i].as_py(), b"") for i in range(a, b)]
                    continue
                table = tables[kind[a] - ASK_WORDS]
                if len(table) != 1 or len(table[0]) != 3:
                    keys, found = (np.concatenate([t[j] for t in table] or [np.empty(0, kind_)]) for j, kind_ in ((0, np.uint64), (1, float)))
                    order = np.argsort(keys)
                    table[:] = [[keys[order], found[order], True]]
                keys, found, _ = table[0]
                for i in range(a, b):
                    at, wanted = wide(get["at"][i].as_py()), np.frombuffer(get["keys"][i].as_py(), np.uint64)
                    where = lookup(keys, wanted)
                    hit = where >= 0
                    at, value = at[hit], found[where[hit]]
                    if kind[a] == ASK_GRAMS and len(at):  # sorted by text, so its values can be added up here
                        first = np.array(runs(at)[0])
                        at, value = at[first], np.add.reduceat(value, first)
                    if len(at):
                        rows.append((int(key[i]), int(kind[a]), narrow(at), narrow(value) if kind[a] == ASK_WORDS else value.tobytes()))
            for j in range(0, len(rows), MESSAGE):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[j : j + MESSAGE]), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "kind", "at", "value"])

    return both.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(bounded(run), "chunk long, kind int, at binary, value binary")


def summed_up(answers: DataFrame) -> DataFrame:
    """(chunk, sums array of (known, log, value) a text) of the answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None
        for batch in batches:
            for chunk, kind, at, value in zip(*(column(batch, c) for c in ("chunk", "kind", "at", "value"))):
                if kind == OWN:  # the first of its chunk
                    if now is not None:
                        yield rows_of(now, sums)
                    now, sums = chunk, np.frombuffer(at, float).reshape(3, -1).copy()
                    continue
                at = wide(at)
                if kind == ASK_WORDS:
                    np.add.at(sums[0], at, 1.0)
                    np.add.at(sums[1], at, np.log10(wide(value) + 1.0))
                else:
                    np.add.at(sums[2], at, np.frombuffer(value, float))
        if now is not None:
            yield rows_of(now, sums)

    def rows_of(chunk: int, sums: np.ndarray) -> pa.RecordBatch:
        known, *others = sums
        ends = pa.array([0, sums.shape[1]], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in (known.astype(np.int64), *others))], names=["chunk", "known", "log", "value"])

    dealt = answers.repartition("chunk").sortWithinPartitions("chunk", F.desc("kind"))
    return dealt.mapInArrow(bounded(run), "chunk long, known array<long>, log array<double>, value array<double>")


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_when: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    train_when = F.lit(True) if train_when is None else train_when
    chunks = written(docs.select(docs[id_col].alias("id"), (~train_when).alias("held_out"), docs[text_col].cast("binary").alias("text")))
    model, vocab, values, buckets = fit(chunks)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    total, norm = model.total, math.log10(model.total + model.distinct + 1)
    sums = summed_up(answered(asked(chunks, shared, buckets), vocab, values, buckets))
    out = chunks.select("chunk", "id", "held_out", "length").join(sums, "chunk")
    out = out.select(F.explode(F.arrays_zip("id", "held_out", "length", "known", "log", "value")).alias("r")).select("r.*")
    base = F.col("log") - F.col("length") * F.lit(norm)
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        F.col("length").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("value")).alias("score"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, train_when=crc_mod(docs["doc_id"], 7) != 2)
