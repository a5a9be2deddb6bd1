"""Phrases of 2 to 5 words by collocation score: a perfect hash a length, counts in arrays, cuts read by slot.

Words. One pass counts words by language exactly, as strings; those with at least ``least`` occurrences get a perfect hash
over 64-bit hashes of (language, word). The second and last pass over the texts turns them into arrays of slots (-1 for a
break or a rare word, runs of it once) and counts the slots. These counts have to equal the exact ones; where a rare word
shares the hash of a frequent one they don't, and the pass is run anew with another seed.

Longer phrases. A phrase of k words is the pair of slots of its first and its last k - 1 words, which is an exact 64-bit
key. Only positions where both are frequent make a key (Apriori). Each task sends its distinct keys, packed by segment, with
counts that stop at ``least``; keys whose sums reach it are the candidates. A perfect hash over the candidates is broadcast,
mappers look all positions up, verify the stored keys, count slots with bincount, and write the slots as the next length's
arrays. The count arrays go up a tree in blocks of BLOCK slots. A cut of a phrase is then the counts of two slots, which
candidates carry from the phrases that they were made of.

Bounds. A broadcast holds at most PART keys (8 bytes a key and 3 bits of hash); more candidates take more passes over the
slot arrays, never more memory. Nothing else is broadcast; the driver sees one part of keys at a time. Segments grow in
number with the corpus, so a task's share stays of one size; hot keys travel once a task.

Defined results: a null text has no words; a null language is ``und``; repeated rows count as often as they stand; columns
other than text and lang aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Remembered, bounded, broadcasting, discard, materialize, slices, to_batch
from .perfect_hash import PerfectHash, mix

LEAST, LONGEST, TOP, FACTOR, RATIO = 100, 5, 2000, 1000, 100
#: Keys of a broadcast, slots of a count block, positions that a task holds, positions a segment, words of a task's counter.
PART, BLOCK, HELD, SEGMENT, WORDS = 1 << 22, 1 << 14, 1 << 21, 1 << 21, 300_000
FANS, SEEDS = 8, 8

#: A-Z become a-z, all ends of pieces become full stops; what is left to split words at are spaces and tabs.
BREAK = b"."
_FOLD = bytes(c + 32 if 65 <= c <= 90 else BREAK[0] if c in b".,;:!?" or 10 <= c <= 13 else c for c in range(256))


def tokens(raw: bytes) -> list[bytes]:
    """Words, with BREAK between pieces."""
    return raw.translate(_FOLD).replace(BREAK, b" . ").split()


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[list[str], list[list[bytes]]]]:
    texts, langs = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist()
    for a, b in slices(texts):
        yield langs[a:b], [tokens(t) if t else [] for t in texts[a:b]]


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n of all words as they are; ``word`` null has all of the language."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        totals: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                totals[lang] += found.total()
                columns = [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
            counts.clear()

        for batch in batches:
            for langs, found in _stretches(batch):
                for lang, ws in zip(langs, found):
                    counts.setdefault(lang, Counter()).update(ws)
                for c in counts.values():
                    del c[BREAK]
                if sum(map(len, counts.values())) >= WORDS:
                    yield from flush()
        yield from flush()
        yield to_batch(schema, lang=list(totals), word=[None] * len(totals), n=list(totals.values()))

    return docs.mapInArrow(bounded(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


# ---- arrays of slots


def squeezed(slots: np.ndarray) -> np.ndarray:
    """Runs of -1 once, one at the end."""
    slots = np.append(slots, -1)
    return slots[(slots >= 0) | np.append(True, slots[:-1] >= 0)].astype(np.int32)


def pairs(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose slot and next slot are both there, and their keys."""
    at = np.flatnonzero((slots[:-1] >= 0) & (slots[1:] >= 0))
    return at, (slots[at].astype(np.uint64) << np.uint64(32)) | slots[at + 1].astype(np.uint64)


def word_keys(langs: list[str], found: list[list[bytes]], hashes: Remembered, tongues: Remembered) -> np.ndarray:
    """Hashes of (language, word) of the texts one after the other, 0 for breaks and after each text."""
    flat = [w for ws in found for w in (*ws, BREAK)]
    keys = np.fromiter(map(hashes.__getitem__, flat), np.uint64, len(flat))
    of = np.repeat(np.array([tongues[x] for x in langs], np.uint64), [len(ws) + 1 for ws in found])
    return np.where(keys == 0, np.uint64(0), mix(keys ^ of))


def _hashers(seed: int) -> tuple[Remembered, Remembered]:
    return Remembered(lambda w: 0 if w == BREAK else xxhash.xxh3_64_intdigest(w, seed) or 1), Remembered(lambda x: xxhash.xxh3_64_intdigest(x, seed + 1))


ROWS = "raw binary, slots binary, block long, counts binary"
_ROWS = pa.schema([("raw", pa.binary()), ("slots", pa.binary()), ("block", pa.int64()), ("counts", pa.binary())])


def counted(source: DataFrame, hashed: Broadcast, base: int, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], more: bool) -> DataFrame:
    """One pass over ``source``: the slots of a part of the keys, and this part's counts in blocks of slots.

    ``keys_of`` yields (raw input, slots so far, positions, keys at these) for each stretch. With ``more`` parts to come the
    raw input is kept beside the slots, else the arrays are squeezed for the next length.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hashed.value
        counts = np.zeros(len(table), np.int64)
        for raw, so_far, at, keys in keys_of(batches):
            slots = table.slots(keys)
            hit = slots >= 0
            counts += np.bincount(slots[hit], minlength=len(table))
            so_far[at[hit]] = slots[hit] + base
            kept = so_far if more else squeezed(so_far)
            if more or len(kept) > 2:  # fewer places hold no pair
                yield to_batch(_ROWS, raw=[raw.tobytes() if more else None], slots=[kept.astype(np.int32).tobytes()], block=[None], counts=[None])
        for b in range(0, len(counts), BLOCK):
            if counts[b : b + BLOCK].any():
                yield to_batch(_ROWS, raw=[None], slots=[None], block=[(base + b) // BLOCK], counts=[counts[b : b + BLOCK].tobytes()])

    return materialize(source.mapInArrow(bounded(look), ROWS), "phrase-slots")


def _from_texts(seed: int) -> Callable:
    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        hashes, tongues = _hashers(seed)
        for batch in batches:
            for langs, found in _stretches(batch):
                keys = word_keys(langs, found, hashes, tongues)
                yield keys, np.full(len(keys), -1, np.int64), np.arange(len(keys)), keys

    return keys_of


def _from_raw(words: bool) -> Callable:
    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for raw, slots in zip(batch.column("raw"), batch.column("slots")):
                so_far = np.frombuffer(slots.as_buffer(), np.int32).astype(np.int64)
                last = np.frombuffer(raw.as_buffer(), np.uint64 if words else np.int32)
                yield last, so_far, *((np.arange(len(last)), last) if words else pairs(last))

    return keys_of


def _from_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for slots in batch.column("slots"):
            last = np.frombuffer(slots.as_buffer(), np.int32)
            yield last, np.full(len(last), -1, np.int64), *pairs(last)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where each key of sorted ``keys`` begins."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def distinct(held: list[np.ndarray], least: int, small: type) -> tuple[np.ndarray, np.ndarray]:
    """The keys of ``held``, sorted, and their counts up to ``least``; ``held`` is emptied, and one copy of it is sorted in place."""
    keys = np.concatenate(held)
    held.clear()
    keys.sort()
    first = _starts(keys)
    n = np.minimum(np.diff(first, append=len(keys)), least).astype(small)
    return keys[first], n


def added(keys: list[np.ndarray], counts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all arrays, sorted, and the sums of their counts up to ``least``; the lists are emptied.

    Counts stay in their narrow type, and no array but the order is wider than its input, so a task holds few times its keys.
    """
    small = counts[0].dtype
    every, n = np.concatenate(keys), np.concatenate(counts)
    keys.clear()
    counts.clear()
    order = np.argsort(every, kind="stable")  # runs are sorted already
    every, n = every[order], n[order]
    del order
    first = _starts(every)
    total = np.add.reduceat(n, first, dtype=np.int64) if len(first) else np.empty(0, np.int64)
    return every[first], np.minimum(total, least, out=total).astype(small)


def candidates(slots: DataFrame, least: int) -> DataFrame:
    """Packed keys (``keys`` binary, ``m`` of them) that at least ``least`` positions have; each key in one row only."""
    segments = int((slots.agg(F.sum(F.octet_length("slots"))).first()[0] or 0) // (4 * SEGMENT) + 1)
    small = np.uint16 if least < 1 << 16 else np.uint32
    packed = pa.schema([("segment", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    out_schema = pa.schema([("keys", pa.binary()), ("m", pa.int64())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = distinct(held, least, small)
            of = np.empty(len(keys), np.int32)
            for a in range(0, len(keys), BLOCK):
                of[a : a + BLOCK] = mix(keys[a : a + BLOCK], 1) % np.uint64(segments)
            order = np.argsort(of, kind="stable")
            keys, n, of = keys[order], n[order], of[order]
            del order
            starts = _starts(of)
            for a, b in zip(starts, np.append(starts[1:], len(of))):
                yield to_batch(packed, segment=[int(of[a])], keys=[keys[a:b].tobytes()], counts=[n[a:b].tobytes()])

        for batch in batches:
            for x in batch.column("slots"):
                held.append(pairs(np.frombuffer(x.as_buffer(), np.int32))[1])
                size += len(held[-1])
                if size >= HELD:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, more, size = [np.empty(0, np.uint64)], [np.empty(0, small)], 0
        for batch in batches:
            for k, c in zip(batch.column("keys"), batch.column("counts")):
                new.append(np.frombuffer(k.as_buffer(), np.uint64))
                more.append(np.frombuffer(c.as_buffer(), small))
                size += len(new[-1])
                if size >= HELD // 4:
                    keys, sums = added(new, more, least)
                    new, more, size = [keys], [sums], 0
        keys, sums = added(new, more, least)
        keys = keys[sums >= least]
        for i in range(0, len(keys), BLOCK):
            part = keys[i : i + BLOCK]
            yield to_batch(out_schema, keys=[part.tobytes()], m=[len(part)])

    sent = slots.select("slots").mapInArrow(bounded(send), "segment long, keys binary, counts binary")
    return materialize(sent.repartition(segments, "segment").mapInArrow(bounded(gather), "keys binary, m long"), "phrase-candidates")


def parts_of(packed: DataFrame, part: int) -> Iterator[np.ndarray]:
    """Keys of the rows in turn, ``part`` at a time: what the driver holds never exceeds a part and a row."""
    held = np.empty(0, np.uint64)
    for row in packed.select("keys").toLocalIterator():
        held = np.append(held, np.frombuffer(row["keys"], np.uint64))
        while len(held) > part:
            yield held[:part]
            held = held[part:]
    if len(held):
        yield held


def tree_sum(blocks: DataFrame, stored: DataFrame) -> DataFrame:
    """slot, first, last, a: blocks summed over FANS shares and then over all; ``stored`` has the keys of each block."""
    added = pa.schema([("block", pa.int64()), ("counts", pa.binary())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column("block").to_pylist(), batch.column("counts")):
                n = np.frombuffer(c.as_buffer(), np.int64)
                sums[b] = sums[b] + n if b in sums else n
        for b, n in sums.items():
            yield to_batch(added, block=[b], counts=[n.tobytes()])

    opened = pa.schema([("slot", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("a", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, k, c in zip(batch.column("block").to_pylist(), batch.column("keys"), batch.column("counts")):
                keys, n = np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int64)
                yield to_batch(opened, slot=np.arange(len(keys)) + b * BLOCK, first=(keys >> np.uint64(32)).astype(np.int64), last=(keys & np.uint64(0xFFFFFFFF)).astype(np.int64), a=n)

    n = max(1, stored.count())
    fan = F.pmod(F.spark_partition_id(), F.lit(FANS)).alias("fan")
    half = blocks.select("block", "counts", fan).repartition(FANS * n, "block", "fan").select("block", "counts").mapInArrow(bounded(add), "block long, counts binary")
    whole = half.repartition(n, "block").mapInArrow(bounded(add), "block long, counts binary")
    return whole.join(stored, "block").mapInArrow(bounded(read), "slot long, first long, last long, a long")


def count_level(spark: SparkSession, source: DataFrame, packed: DataFrame, first_pass: Callable, words: bool, part: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Arrays of slots and the table (slot, first, last, a) of all candidates, a part of them a pass; None without candidates."""
    total = packed.agg(F.sum("m")).first()[0] or 0
    done, base, level, rows, current, keys_of = 0, 0, None, None, source, first_pass
    for keys in parts_of(packed, part):
        table, before = PerfectHash(keys), rows
        done += len(keys)
        with broadcasting(spark, table) as shared:
            rows = counted(current, shared, base, keys_of, done < total)
        stored = pa.table({"block": [(base + b) // BLOCK for b in range(0, len(table), BLOCK)], "keys": [table.keys[b : b + BLOCK].tobytes() for b in range(0, len(table), BLOCK)]})
        one = materialize(tree_sum(rows.where("block is not null").select("block", "counts"), spark.createDataFrame(stored)), "phrase-counts")
        level = one if level is None else level.unionByName(one)
        base += -(-len(table) // BLOCK) * BLOCK  # parts begin at a block
        if base > 1 << 31:
            raise OverflowError(f"{base} phrases of one length don't fit 32-bit slots")
        if before is not None:
            discard(before)
        current, keys_of = rows.where("slots is not null"), _from_raw(words)
    return rows, level


def _dense(words: DataFrame, seed: int) -> DataFrame:
    """The frequent words with the key of their hash."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, tongues = _hashers(seed)
        for batch in batches:
            langs, ws = batch.column("lang").to_pylist(), batch.column("word").cast(pa.binary()).to_pylist()
            k = mix(np.array([hashes[w] for w in ws], np.uint64) ^ np.array([tongues[x] for x in langs], np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k.view(np.int64))], names=["lang", "word", "n", "key"])

    return words.mapInArrow(bounded(key), "lang string, word string, n long, key long")


def _packed(words: DataFrame) -> DataFrame:
    schema = pa.schema([("keys", pa.binary()), ("m", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield to_batch(schema, keys=[batch.column("key").to_numpy().astype(np.int64).view(np.uint64).tobytes()], m=[batch.num_rows])

    return words.select("key").mapInArrow(bounded(pack), "keys binary, m long")


def first_level(docs: DataFrame, words: DataFrame, part: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Arrays of word slots and the words with slot and count; counts by slot equal the exact ones or the seed changes."""
    spark = docs.sparkSession
    for seed in range(SEEDS):
        keyed = materialize(_dense(words, 2 * seed), "phrase-words")
        n, different = keyed.agg(F.count("key"), F.countDistinct("key")).first()
        if n == different:
            slots, level = count_level(spark, docs, _packed(keyed), _from_texts(2 * seed), True, part)
            if level is None:
                return None, None
            named = level.select("slot", "a", F.shiftleft("first", 32).bitwiseOR(F.col("last")).alias("key")).join(keyed, "key")
            named = materialize(named.select("slot", "a", "lang", "word", "n"), "phrase-level")
            discard(keyed)
            if named.where("a <> n").isEmpty():
                return slots, named.select("slot", "a", "lang", F.col("word").alias("phrase"), F.col("word").alias("ending"), F.array().cast("array<bigint>").alias("ls"), F.array().cast("array<bigint>").alias("rs"))
            discard(slots, named)
    raise RuntimeError("no seed tells the frequent words apart")  # chance of a clash, to the power of SEEDS


def levels(docs: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST, part: int = PART) -> list[DataFrame]:
    """Candidates of 1 to ``longest`` words: slot, a, lang, phrase, ending (its last word), first and last (slots), and the
    counts ``ls`` of its first 1, 2, ... words and ``rs`` of its last 1, 2, ... words."""
    slots, level = first_level(docs, words, part)
    found = [level] if level is not None else []
    while slots is not None and len(found) < longest:
        arrays = slots.where("slots is not null").select("slots")
        packed = candidates(arrays, least)
        longer, table = count_level(docs.sparkSession, arrays, packed, _from_slots, False, part)
        discard(slots, packed)
        if table is None:
            break
        p = level.select(F.col("slot").alias("first"), "lang", F.col("phrase").alias("_p"), F.col("ls").alias("_ls"), F.col("a").alias("_l"))
        s = level.select(F.col("slot").alias("last"), "ending", F.col("rs").alias("_rs"), F.col("a").alias("_r"))
        level = table.join(p, "first").join(s, "last").select("slot", "a", "lang", F.concat_ws(" ", "_p", "ending").alias("phrase"), "ending", F.array_append("_ls", F.col("_l")).alias("ls"), F.array_append("_rs", F.col("_r")).alias("rs"), "first", "last")
        level = materialize(level, "phrase-level")
        found.append(level)
        slots = longer
    if slots is not None:
        discard(slots)
    return found


def cut_scores(level: DataFrame, totals: DataFrame, length: int, factor: int = FACTOR) -> DataFrame:
    """l, r, n, score of the cut with the least floored score, ties to the shortest first part; exact in 38 digits."""
    cut = lambda k: F.struct(F.expr(f"(CAST({factor} AS DECIMAL(5,0)) * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(15,0))) div (CAST(ls[{k - 1}] AS DECIMAL(18,0)) * CAST(rs[{length - k - 1}] AS DECIMAL(18,0)))").alias("score"), F.lit(k).alias("k"), F.col("ls")[k - 1].alias("l"), F.col("rs")[length - k - 1].alias("r"))
    best = F.array_min(F.array(*[cut(k) for k in range(1, length)]))
    return level.join(totals, "lang").withColumn("_best", best).select("slot", "lang", "phrase", "a", F.col("_best.l").alias("l"), F.col("_best.r").alias("r"), "n", F.col("_best.score").alias("score"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, factor: int = FACTOR, ratio: int = RATIO, part: int = PART) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases that no longer candidate covers.

    A candidate is covered where a longer one that contains it has at least ``ratio`` percent of its count. Counts fall with
    length, so it's enough to look at the candidates one word longer.
    """
    spark = docs.sparkSession
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    counts = materialize(word_counts(texts).where((F.col("n") >= least) | F.col("word").isNull()), "phrase-words")
    totals = counts.where("word is null").select("lang", "n")
    found = levels(texts, counts.where("word is not null"), least, longest, part)
    out = None
    for k in range(2, len(found) + 1):
        scored = cut_scores(found[k - 1], totals, k, factor)
        if k < len(found):
            above = found[k]
            cover = above.select(F.col("first").alias("slot"), "a").unionByName(above.select(F.col("last").alias("slot"), "a")).groupBy("slot").agg(F.max("a").alias("_above"))
            scored = scored.join(cover, "slot", "left").where(F.col("_above").isNull() | (100 * F.col("_above") < ratio * F.col("a"))).drop("_above")
        scored = scored.drop("slot")
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d WHERE t IS NOT NULL),
grams AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, range(1, 6) AS r(k))),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND n >= 100),
cuts AS (
  SELECT c.lang, c.k, c.phrase, a, l.n AS l, r.n AS r, t.n AS n, cut, (1000::HUGEINT * a * t.n) // (l.n::HUGEINT * r.n) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1 : cut], ' ') AND l.k = cut
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut + 1 : c.k], ' ') AND r.k = c.k - cut
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(ws[i : i + len - 1], ' ') AS phrase, max(a) AS above FROM (SELECT lang, ws, a, len, unnest(range(1, k - len + 2)) AS i FROM cand, range(2, 5) AS r(len) WHERE len < k) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.above IS NULL OR 100 * i.above < 100 * b.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE C) AS rank, phrase, a, l, r, n, score FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
