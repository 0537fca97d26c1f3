"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the 3- and 4-byte windows of the lower-case text in which every
run of bytes other than letters reads as spaces; each is hashed to one of
``BUCKETS`` embeddings. A text is the mean of its embeddings, a softmax over a
linear map gives the languages. Both layers are trained by stochastic gradient
descent in numpy on a bounded sample: exactly the ``per_lang`` rows of each
language with the least checksum of id and text (equal rows count once), whose
subword counts are taken in tasks, so no text reaches the driver. A part of the
sample is held back to calibrate: it sets the softmax temperature and the score
below which a prediction is ``rejected``. A model grows with the languages.

As the map is linear, a subword contributes a fixed vector of logits, so whole
texts are scored in one pass over their bytes.

Edge cases: a null text or one without a Unicode letter is ``und`` with score 0
and rejected; without training rows every text is ``und``; null labels are not
learned from; null and repeated ids are scored like any row; very long texts are
read whole; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import hash_fold, small, written
from quarry.llm.text import chunks, utf8

BUCKETS = 1 << 15
DIM = 16
PER_LANG = 800
SMOOTH = 0.01  # of the calibration targets: a sample without errors must not make scores certain
KEEP = 0.99  # share of right calibration predictions that stay accepted

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def subwords(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of a chunk and where each document's begin; BUCKETS marks none."""
    lower = pc.fill_null(pc.utf8_lower(column.cast(pa.large_string())), "")
    data, offsets = utf8(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), lower,
                                                     pa.scalar("   ", pa.large_string()), pa.scalar(" ", pa.large_string())))
    x = np.where(_LETTER[data], data, 32).astype(np.uint32)
    n = len(x)
    three = np.zeros(n, np.uint32)
    three[:n - 2] = x[:-2] | x[1:-1] << 8 | x[2:] << 16
    four = np.zeros(n, np.uint32)
    four[:n - 3] = three[:n - 3] | x[3:] << 24
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    with np.errstate(over="ignore"):
        a = (three * np.uint32(0x9E3779B1) >> shift).astype(np.int32)
        b = ((four ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) >> shift).astype(np.int32)
    blank = three == (32 | 32 << 8 | 32 << 16)
    for back in (1, 2):
        blank[offsets[1:] - back] = True
    a[blank] = BUCKETS
    blank[offsets[1:] - 3] = True
    b[blank] = BUCKETS
    return np.concatenate([a, b]), np.concatenate([offsets[:-1], offsets[:-1] + n])


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # (BUCKETS + 1, languages): what each subword adds; the last row is 0
    temperature: float = 1.0
    reject_below: float = 0.0

    def raw(self, column: pa.Array) -> np.ndarray:
        bucket, start = subwords(column)
        n = len(column)
        order = np.concatenate([start, [len(bucket)]])
        total = np.add.reduceat(self.logits[bucket], order[:-1], axis=0)
        seen = np.add.reduceat((bucket < BUCKETS).astype(np.float32), order[:-1])
        total, seen = total[:n] + total[n:], seen[:n] + seen[n:]
        return total / np.maximum(seen, 1)[:, None]

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.raw(column).astype(np.float64) / self.temperature)
        return p.argmax(axis=1), p.max(axis=1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def counts(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text of a chunk, and how often each occurs."""
    bucket, start = subwords(column)
    n, edge = len(column), np.concatenate([start, [len(bucket)]])
    out = []
    for d in range(n):
        own = np.concatenate([bucket[edge[d]:edge[d + 1]], bucket[edge[n + d]:edge[n + d + 1]]])
        out.append(np.unique(own[own < BUCKETS], return_counts=True))
    return out


def train(texts: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 6, rate: float = 20.0,
          seed: int = 0) -> Model:
    """Embeddings and softmax by stochastic gradient descent on the ``counts`` of texts, then
    calibration on every fifth text."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    docs = [(i, (n / max(1, n.sum())).astype(np.float32)) for i, n in texts]
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM)).astype(np.float32)
    w = np.zeros((DIM, len(names)), np.float32)
    fit = [d for d in range(len(docs)) if d % 5 or len(docs) < 10]
    steps, step = epochs * len(fit), 0
    for _ in range(epochs):
        for d in rng.permutation(fit):
            i, share = docs[d]
            if not len(i):
                continue
            h = share @ e[i]
            g = softmax(h @ w)
            g[y[d]] -= 1
            lr = rate * (1 - step / steps)
            step += 1
            back = w @ g
            w -= 0.05 * lr * np.outer(h, g)
            e[i] -= lr * share[:, None] * back
    e[BUCKETS] = 0
    model = Model(names, (e @ w).astype(np.float32))
    check = [d for d in range(len(docs)) if d not in set(fit)] or fit
    if check:
        z = np.array([docs[d][1] @ model.logits[docs[d][0]] for d in check], np.float64)
        t = np.geomspace(0.02, 20, 60)
        goal = np.full((len(check), len(names)), SMOOTH / len(names))
        goal[np.arange(len(check)), y[check]] += 1 - SMOOTH
        loss = [-(goal * np.log(softmax(z / x) + 1e-300)).sum(axis=1).mean() for x in t]
        model.temperature = float(t[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
        model.reject_below = float(np.quantile(right, 1 - KEEP)) if len(right) else 0.0
    return model


def sample(docs: DataFrame, per_lang: int = PER_LANG, seed: int = 1) -> DataFrame:
    """``lang, key, text``: the ``per_lang`` labelled rows of each language, outside the held-out fold, of least key."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (hash_fold("doc_id", 3) != 1)).select(
        "lang", F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text").alias("key"), "text")
    by = Window.partitionBy("lang").orderBy("key")  # cut to per_lang rows before and after the shuffle
    picked = (rows.select("lang", "key").distinct().withColumn("rank", F.row_number().over(by))
              .where(F.col("rank") <= per_lang).drop("rank"))
    return (rows.join(small(written(picked, "picked"), 64), ["lang", "key"])
            .groupBy("lang", "key").agg(F.min("text").alias("text")))


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    def run(batches):
        for batch in batches:
            for part in chunks(batch, limit=1 << 20):
                found = counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([
                    part.column("lang"), part.column("key"), pa.array([i.tolist() for i, _ in found], pa.list_(pa.int32())),
                    pa.array([n.tolist() for _, n in found], pa.list_(pa.int64()))], ["lang", "key", "bucket", "n"])

    got = sample(docs, per_lang).mapInArrow(run, "lang string, key long, bucket array<int>, n array<long>").toArrow()
    got = got.sort_by([("key", "ascending"), ("lang", "ascending")])
    return train([(np.array(i.values, np.int64), np.array(n.values, np.int64)) for i, n in zip(got["bucket"], got["n"], strict=True)],
                 got["lang"].to_pylist())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            for part in chunks(batch, limit=1 << 20):
                letter = part.column("letter").to_numpy(zero_copy_only=False)
                if m.langs:
                    best, score = m.predict(part.column("text"))
                else:
                    best, score, letter = np.zeros(part.num_rows, int), np.zeros(part.num_rows), letter & False
                best[~letter], score[~letter] = len(m.langs), 0.0
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score),
                    pa.array(~letter | (score < m.reject_below))], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean")
