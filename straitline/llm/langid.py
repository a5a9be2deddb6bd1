"""Language identification by word-first backoff.

A word known to some language scores its log10 relative frequency in each; a language that lacks it gets a fixed penalty.
A word that none knows backs off to the mean over its character n-grams of the greatest length of which any is known, then
to shorter ones, then to the penalty. A text takes the language of the greatest mean over its words.

Word and n-gram frequencies are sums over all labelled training rows. An entry stays if its share of its language's
words (of n-grams of its length) is at least FLOOR, so a language keeps at most 1/FLOOR words and 1/FLOOR n-grams of a
length. What is broadcast are (entry, language, value) triples, so it is bounded by 5/FLOOR of them for each language,
whatever the size of the corpus, and grows in proportion to the number of languages, which has no limit.

Cases: a null text or one without a letter is ``und`` with score 0; ties go to the language that sorts first; rows without
a language don't train; if none trains, all is ``und``; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, column, crc_mod, discard, materialize, slices

FLOOR, MAX_N = 5e-6, 4
PENALTY = -7.0
FLUSH = 300_000
#: Pairs of entry and language that a task expands or remembers at once, and cells of a dense block of scores.
PAIRS, CELLS = 4_000_000, 4_000_000
_LETTERS = re.compile(r"[^\W\d_]+")


def text_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none unless some character is a letter."""
    found = _LETTERS.findall(text.lower()) if text else []
    return found if any(w.isalpha() or any(map(str.isalpha, w)) for w in found) else []


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c.keys()), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])
        counts.clear()

    for batch in batches:
        texts, langs = column(batch, "text"), column(batch, "lang")
        for a, b in slices(texts):
            for t, lang in zip(texts[a:b], langs[a:b]):
                counts.setdefault(lang, Counter()).update(text_words(t))
            if sum(map(len, counts.values())) > FLUSH:
                yield from rows()
    yield from rows()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, int], Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, size), c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array([size] * len(c), pa.int32()), pa.array(list(c.keys()), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "size", "gram", "n"])
        counts.clear()

    for batch in batches:
        for lang, word, n in zip(column(batch, "lang"), column(batch, "word"), column(batch, "n")):
            for size in range(1, MAX_N + 1):
                c = counts.setdefault((lang, size), Counter())
                for g in grams(word, size):
                    c[g] += n
        if sum(map(len, counts.values())) > FLUSH:
            yield from rows()
    yield from rows()


class Entries:
    """Words or n-grams with what each adds to the penalty, as (language, value) pairs of an entry in a row."""

    def __init__(self, at: dict[str, int], ends: np.ndarray, lang: np.ndarray, value: np.ndarray):
        self.at, self.ends, self.lang, self.value = at, np.concatenate([[0], ends]).astype(np.int64), lang.astype(np.int32), value

    @classmethod
    def of(cls, entries: dict[str, dict[str, float]], langs: list[str]) -> Entries:
        place = {lang: j for j, lang in enumerate(langs)}
        pairs = [(place[lang], v - PENALTY) for by in entries.values() for lang, v in by.items()]
        lang, value = zip(*pairs) if pairs else ((), ())
        return cls({w: i for i, w in enumerate(entries)}, np.cumsum([len(by) for by in entries.values()]), np.array(lang, np.int32), np.array(value, float))

    @classmethod
    def of_rows(cls, rows: pa.Table, langs: list[str]) -> Entries:
        """Of rows (entry, lang, v), those of an entry together."""
        at: dict[str, int] = {}
        own = np.array([at.setdefault(w, len(at)) for w in rows.column(0).to_pylist()], dtype=np.int64)
        lang = pc.index_in(rows.column(1), value_set=pa.array(langs, pa.string())).to_numpy()
        return cls(at, np.cumsum(np.bincount(own, minlength=len(at))), lang, rows.column(2).to_numpy() - PENALTY)

    @classmethod
    def of_dense(cls, names: list[str], scores: np.ndarray) -> Entries:
        own, lang = np.nonzero(scores)
        return cls({w: i for i, w in enumerate(names)}, np.cumsum(np.bincount(own, minlength=len(names))), lang, scores[own, lang])

    def extend(self, others: list[Entries]) -> None:
        """Take in entries that are not here yet."""
        for e in others:
            self.at.update((w, i) for i, w in enumerate(e.at, len(self.at)))
        self.ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(e.ends) for e in (self, *others)]))])
        self.lang, self.value = (np.concatenate([getattr(e, c) for e in (self, *others)]) for c in ("lang", "value"))

    def size(self) -> int:
        return len(self.at) + len(self.value)

    def add(self, out: np.ndarray, owner: np.ndarray, ids: np.ndarray) -> None:
        """Add each entry's pairs to the row of ``out`` that owns it, at most some PAIRS at once."""
        langs, n = out.shape[1], np.diff(self.ends)[ids]
        cuts = np.searchsorted(np.cumsum(n), np.arange(PAIRS, int(n.sum()), PAIRS)) + 1 if len(n) else []
        for who, which, k in zip(*(np.split(x, np.unique(cuts)) for x in (owner, ids, n))):
            at = np.repeat(self.ends[which], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            out += np.bincount(np.repeat(who, k) * langs + self.lang[at], weights=self.value[at], minlength=out.size).reshape(out.shape)


class Model:
    """Languages, words and n-grams by length. ``words`` and ``ngrams`` are Entries, or dicts of an entry's scores."""

    def __init__(self, langs: list[str], words: Entries | dict, ngrams: list):
        entries = lambda e: e if isinstance(e, Entries) else Entries.of(e, langs)
        self.langs, self.words, self.grams = langs, entries(words), [entries(g) for g in ngrams]

    def raised(self, unseen: list[str]) -> np.ndarray:
        """Scores above the penalty of words that no language knows, a row a word."""
        out, open_ = np.zeros((len(unseen), len(self.langs))), np.arange(len(unseen))
        for size in range(len(self.grams), 0, -1):
            get, flat, owner = self.grams[size - 1].at.get, [], []
            for i in open_.tolist():
                found = [g for g in map(get, grams(unseen[i], size)) if g is not None]
                flat += found
                owner += [i] * len(found)
            if flat:
                own = np.array(owner)
                self.grams[size - 1].add(out, own, np.array(flat))
                n = np.bincount(own, minlength=len(unseen))
                got = open_[n[open_] > 0]
                out[got] /= n[got, None]
                open_ = open_[n[open_] == 0]
        return out

    def back_off(self, unseen: list[str]) -> np.ndarray:
        return PENALTY + self.raised(unseen)

    def score(self, docs: list[list[str]], memory: list[Entries] | None = None) -> np.ndarray:
        """Mean score of each text's words, a row a text; NaN without words.

        ``memory`` keeps the scores of unseen words from call to call: one Entries of at most PAIRS pairs.
        """
        memory = [] if memory is None else memory
        flat, sizes = [w for ws in docs for w in ws], np.array([len(ws) for ws in docs], dtype=np.int64)
        owner, out = np.repeat(np.arange(len(docs)), sizes), np.zeros((len(docs), len(self.langs)))

        def add(known: Entries, at: np.ndarray) -> np.ndarray:
            """Add the words at these places that are known; the places of the others."""
            ids = np.array([known.at.get(flat[i], -1) for i in at.tolist()], dtype=np.int64)
            known.add(out, owner[at[ids >= 0]], ids[ids >= 0])
            return at[ids < 0]

        left = add(self.words, np.arange(len(flat)))
        for known in memory:
            left = add(known, left)
        fresh, new = list(dict.fromkeys(flat[i] for i in left.tolist())), []
        block = max(CELLS // max(len(self.langs), 1), 1)
        for i in range(0, len(fresh), block):
            found = Entries.of_dense(fresh[i : i + block], self.raised(fresh[i : i + block]))
            left = add(found, left)
            if sum(e.size() for e in (*new, found)) <= PAIRS:
                new.append(found)
        if sum(e.size() for e in (*memory, *new)) > PAIRS:
            memory.clear()
        if new and not memory:
            memory.append(new.pop(0))
        if new:
            memory[0].extend(new)
        with np.errstate(invalid="ignore"):
            return PENALTY + out / np.where(sizes, sizes, np.nan)[:, None]


def fit(train: DataFrame) -> Model:
    """Model of rows (text, lang); counts cover all rows."""
    counts = materialize(train.where("lang is not null").mapInArrow(bounded(_count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())

    def kept(rows: DataFrame, entry: str, by: list[str]) -> DataFrame:
        often = rows.join(rows.groupBy(*by).agg(F.sum("n").alias("_all")), by)  # a row a language, or language and length
        return often.where(F.col("n") >= F.lit(FLOOR) * F.col("_all")).select(entry, "lang", F.log10(F.col("n") / F.col("_all")).alias("v"), *[c for c in by if c != "lang"]).orderBy(entry, "lang")

    words = Entries.of_rows(kept(counts, "word", ["lang"]).toArrow(), langs)
    grams_ = materialize(counts.mapInArrow(bounded(_count_grams), "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")), "langid-grams")
    found = kept(grams_, "gram", ["lang", "size"]).toArrow()
    discard(counts, grams_)
    return Model(langs, words, [Entries.of_rows(found.filter(pc.equal(found.column("size"), n)), langs) for n in range(1, MAX_N + 1)])


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", also: dict[str, Column] | None = None) -> DataFrame:
    """(id, columns of ``also``, lang_pred, score): score is the share of the best language in the mean likelihoods."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    also = also or {}
    rows = docs.select(docs[id_col].alias(id_col), *[c.alias(k) for k, c in also.items()], docs[text_col].alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memory = shared.value, []
        rows_at_once = max(CELLS // max(len(m.langs), 1), 1)
        for batch in batches:
            texts = column(batch, "_text")
            for a, b in slices(texts):
                langs, scores = ["und"] * (b - a), [0.0] * (b - a)
                for first in range(a, b if m.langs else a, rows_at_once):
                    means = m.score([text_words(t) for t in texts[first : min(first + rows_at_once, b)]], memory)
                    for i in np.flatnonzero(~np.isnan(means[:, 0])):
                        j = int(means[i].argmax())
                        langs[first - a + i], scores[first - a + i] = m.langs[j], float(1 / np.sum(10.0 ** (means[i] - means[i, j])))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(bounded(run), f"{fields}, lang_pred string, score double")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_mod(docs["doc_id"], 4) == 2
    model = fit(docs.where(~held_out).select("text", "lang"))
    return identify(docs, model, also={"held_out": held_out})
