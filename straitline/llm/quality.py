"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct words, hashed into WORD_SLOTS, one indicator for the bucket of each structure statistic
(case, symbols, digits, repetition of words and lines, line lengths, word lengths) and of its length, and two for each
metadata column: the bucket of its value, and that of its ratio to the length of the text. Their pairs with words and with
each other are what the low rank is for. The machine scores ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; by the sum-of-squares identity the pairs cost
``1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)``, linear in the number of features.

It is trained by mini-batch AdaGrad on logistic loss on the driver, from at most SAMPLE labelled rows, those of the
smallest hash of their id: a documented bound. Features and scores cover whole texts of all rows.

Cases: a null or empty text has the structure features of the empty text; rows without a 0/1 label don't train; an id
with several labels counts as its smallest; repeated rows are scored each; without labels every score is 0.5; with one
class only, its share decides; an empty table gives an empty result; a metadata column that is not there is left out, a
null or non-finite value of one has a bucket of its own; other columns are ignored, and may have any name.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, bounded, column, crc_mod, give_back, slices, words

WORD_SLOTS, RANK = 1 << 16, 8
SAMPLE, EPOCHS, BATCH, STEP, DECAY = 6000, 4, 64, 0.1, 1e-5
THRESHOLD = 0.3
STATS, BUCKETS = 14, 12
META_SLOTS = 1 << 10
SLOTS = WORD_SLOTS + STATS * BUCKETS + META_SLOTS
#: Numeric columns that are read as metadata where the table has them; never labels, languages, sources or ids.
METADATA = ("n_chars",)

_UPPER, _LOWER, _DIGIT, _SPACE, _PUNCT = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCT[list(b"!#$%&*+/<=>?@\\^_`{|}~")] = True


def word_slots() -> Remembered:
    return Remembered(lambda w: zlib.crc32(w) & (WORD_SLOTS - 1))


def metadata(values: dict[str, float | None], size: int) -> list[int]:
    """Slots of a row's metadata: the octave of each value, in halves, and its ratio to the size of the text in quarters."""
    out = []
    for name, v in values.items():
        known = v is not None and np.isfinite(float(v))
        octave = int(2 * np.log2(1 + abs(float(v)))) * (1 if v >= 0 else -1) if known else "none"
        ratio = int(min(8.0, max(-8.0, 4 * np.log2((1 + abs(float(v))) / (1 + size))))) if known else "none"
        out += [WORD_SLOTS + STATS * BUCKETS + zlib.crc32(f"{name}:{kind}:{x}".encode()) % META_SLOTS for kind, x in (("value", octave), ("ratio", ratio))]
    return out


def structure(raw: bytes, ws: list[bytes], counts: Counter) -> list[float]:
    """STATS statistics, most of them shares in [0, 1]."""
    n = max(len(raw), 1)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(int(byte[_UPPER].sum() + byte[_LOWER].sum()), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    nw = max(len(ws), 1)
    lengths = [len(w) for w in ws]
    repeats = sum(a == b for a, b in zip(ws, ws[1:]))
    sentences = byte[46] + byte[33] + byte[63]
    return [
        byte[_UPPER].sum() / letters,
        min(1.0, 10 * byte[_DIGIT].sum() / n),
        min(1.0, 5 * byte[_PUNCT].sum() / n),
        min(1.0, 10 * byte[ord("|")] / n),
        min(1.0, 5 * byte[ord("!")] / n),
        byte[_SPACE].sum() / n,
        len(counts) / nw,
        max(counts.values(), default=0) / nw,
        repeats / nw,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(len(x) < 25 for x in lines) / max(len(lines), 1),
        min(1.0, sum(lengths) / nw / 16),
        min(1.0, 4 * sentences / nw),
        min(1.0, np.log2(1 + nw) / 16),
    ]


def features(texts: list, meta: dict[str, list] | None = None, slots: Remembered | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, number of features of each text), texts one after the other; ``meta``: metadata by column.

    Distinct words weigh ``1/sqrt(count)`` in all, so a long text is no larger than a short one; indicators weigh 1/2.
    """
    slots, meta = word_slots() if slots is None else slots, meta or {}
    idx, val, n = [], [], []
    for i, t in enumerate(texts):
        raw = t or b""
        ws = words(raw)
        counts = Counter(ws)
        s = structure(raw, ws, counts)
        own = [slots[w] for w in counts]
        other = [WORD_SLOTS + j * BUCKETS + min(BUCKETS - 1, int(v * (BUCKETS - 1) + 0.999)) for j, v in enumerate(s)] + metadata({k: v[i] for k, v in meta.items()}, len(raw))
        idx.append(np.array(own + other, dtype=np.int64))
        val.append(np.concatenate([np.full(len(own), 1 / max(len(own), 1) ** 0.5, np.float32), np.full(len(other), 0.5, np.float32)]))
        n.append(len(own) + len(other))
    return np.concatenate(idx), np.concatenate(val), np.array(n)


class Machine:
    def __init__(self, w0: float = 0.0):
        self.w0, self.w = w0, np.zeros(SLOTS, np.float32)
        self.v = np.random.default_rng(7).normal(0, 0.05, (SLOTS, RANK)).astype(np.float32)

    def parts(self, idx, val, n):
        """(score, sums of v x) of each text."""
        starts = np.cumsum(n) - n
        vx = self.v[idx] * val[:, None]
        s = np.add.reduceat(vx, starts, axis=0)
        q = np.add.reduceat((vx * vx).sum(1), starts)
        return self.w0 + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * ((s * s).sum(1) - q), s

    def predict(self, idx, val, n) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(idx, val, n)[0].astype(np.float64), -35, 35)))


def train(idx: np.ndarray, val: np.ndarray, n: np.ndarray, y: np.ndarray) -> Machine:
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    m = Machine(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        m.v[:] = 0
        return m
    gw, gv, g0 = np.full(SLOTS, 1e-6, np.float32), np.full((SLOTS, RANK), 1e-6, np.float32), 1e-6
    starts = np.cumsum(n) - n
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            rows = order[i : i + BATCH]
            take = np.concatenate([np.arange(starts[r], starts[r] + n[r]) for r in rows])
            bi, bv, bn = idx[take], val[take], n[rows]
            score, s = m.parts(bi, bv, bn)
            d = (1 / (1 + np.exp(-np.clip(score, -35, 35))) - y[rows]).astype(np.float32) / len(rows)
            dx = np.repeat(d, bn) * bv
            dv = dx[:, None] * (np.repeat(s, bn, axis=0) - m.v[bi] * bv[:, None])
            slots, at = np.unique(bi, return_inverse=True)
            w_grad = np.bincount(at, weights=dx, minlength=len(slots)) + DECAY * m.w[slots]
            v_grad = np.stack([np.bincount(at, weights=dv[:, f], minlength=len(slots)) for f in range(RANK)], axis=1) + DECAY * m.v[slots]
            gw[slots] += w_grad**2
            gv[slots] += v_grad**2
            m.w[slots] -= STEP * w_grad / np.sqrt(gw[slots])
            m.v[slots] -= STEP / 2 * v_grad / np.sqrt(gv[slots])
            g0 += float(d.sum()) ** 2
            m.w0 -= STEP * float(d.sum()) / g0**0.5
    return m


def _inputs(docs: DataFrame, text_col: str, meta: tuple[str, ...]) -> tuple[list[Column], list[str]]:
    """Text and metadata of ``docs`` under names of their own; the metadata columns that are there."""
    have = [m for m in meta if m in docs.columns]
    return [docs[text_col].cast("binary").alias("_fm_text"), *[docs[m].cast("double").alias(f"_fm_{i}") for i, m in enumerate(have)]], have


def _featured(batch: pa.RecordBatch, have: list[str], slots: Remembered) -> Iterator[tuple[int, int, tuple]]:
    """(first row, end, features) of the slices of a batch with the columns of ``_inputs``."""
    texts = column(batch, "_fm_text")
    meta = {m: column(batch, f"_fm_{i}") for i, m in enumerate(have)}
    for a, b in slices(texts):
        yield a, b, features(texts[a:b], {m: v[a:b] for m, v in meta.items()}, slots)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta: tuple[str, ...] = METADATA) -> Machine:
    """The machine of at most SAMPLE labelled documents. Only the sampled ids, a fixed number, are broadcast."""
    ids = labels.where(labels[label_col].isin(0, 1) & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    inputs, have = _inputs(docs, text_col, meta)
    rows = docs.select(docs[id_col].alias("_id"), *inputs).join(F.broadcast(ids), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = word_slots()
        for batch in batches:
            key, y = batch.column(0), batch.column(batch.num_columns - 1)
            for a, b, (idx, val, n) in _featured(batch, have, slots):
                cut = np.cumsum(n)[:-1]
                yield pa.RecordBatch.from_arrays([key.slice(a, b - a), y.slice(a, b - a), pa.array([x.astype(np.int32) for x in np.split(idx, cut)], pa.list_(pa.int32())), pa.array(np.split(val, cut), pa.list_(pa.float32()))], names=["id", "y", "idx", "val"])

    kind = docs.schema[id_col].dataType.simpleString()
    # an id may have several rows: the one with the smallest features stands for it, whatever the order of the rows
    found = rows.mapInArrow(bounded(run), f"id {kind}, y int, idx array<int>, val array<float>")
    got = found.groupBy("id").agg(F.min(F.struct("idx", "val", "y")).alias("r")).select("id", "r.*").toArrow().to_pandas().sort_values("id", kind="stable")
    if not len(got):
        return train(np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.int64), np.empty(0))
    machine = train(np.concatenate(got.idx.tolist()).astype(np.int64), np.concatenate(got.val.tolist()).astype(np.float32), got.idx.map(len).to_numpy(), got.y.to_numpy(dtype=np.float64))
    del got
    give_back()  # the sample would stay with the driver's process
    return machine


def score(docs: DataFrame, machine: Machine, *, text_col: str = "text", keep: dict[str, Column], threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted"), meta: tuple[str, ...] = METADATA) -> DataFrame:
    """The columns of ``keep``, then score and predicted under ``names``: one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    inputs, have = _inputs(docs, text_col, meta)
    rows = docs.select(*inputs, *[c.alias(k) for k, c in keep.items()])
    first = len(inputs)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[first:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = word_slots()
        for batch in batches:
            for a, b, found in _featured(batch, have, slots):
                p = shared.value.predict(*found)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[first:], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*part.schema.names[first:], *names])

    return rows.mapInArrow(bounded(run), f"{fields}, {names[0]} double, {names[1]} int")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    machine = fit(docs, labels.where(crc_mod(labels["doc_id"], 5) != 0))
    return score(docs, machine, keep={"doc_id": docs["doc_id"], "held_out": crc_mod(docs["doc_id"], 5) == 0})


def accept(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", meta: tuple[str, ...] = METADATA) -> DataFrame:
    """``docs`` without the rows that the machine rejects, all columns kept, whatever their names."""
    machine = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, meta=meta)
    alias = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    scored = score(docs, machine, text_col=text_col, keep={a: docs[c] for c, a in alias.items()}, names=("_fm_score", "_fm_predicted"), meta=meta)
    return scored.where("_fm_predicted = 1").select(*[F.col(a).alias(c) for c, a in alias.items()])
