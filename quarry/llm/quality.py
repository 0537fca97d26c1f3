"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text: its words hashed to ``WORDS`` buckets (weight: logarithm of
the count, the words of a text having length 1 together), ratios that describe
its structure, and its length as metadata says. The machine adds to a linear
model the products of all pairs of features, each weighted by the inner product
of two vectors of ``RANK`` numbers; by the identity
``sum_{i<j} <v_i, v_j> x_i x_j = ((sum v_i x_i)^2 - sum v_i^2 x_i^2) / 2`` that
takes time linear in the features. It is trained in numpy on at most ``limit``
labelled rows (those with the smallest hash of the id) outside the held-out fold.

Edge cases: null and empty texts have no words and zero ratios and are scored
like any other; null labels are not learned from, repeated labels of an id count
by their majority; without a label of each kind every score is the share of
label 1 (0.5 without labels); null or repeated ids are scored row by row; a
missing length is the text's; very long texts are read whole; further columns
are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hash_fold, trimmed
from quarry.llm.text import Words, chunks, utf8

WORDS = 1 << 16
RANK = 8
LIMIT = 6000
ACCEPT = 0.3

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "line": (10, 13),
    "stop": b".?,;:", "bang": b"!", "bar": b"|", "symbol": b"#$%&*@^~=+<>_\\/", "bracket": b"()[]{}\"'`", "wide": range(128, 256),
}
_KIND = np.zeros(256, np.int64)
for _i, _v in enumerate(_CLASSES.values()):
    _KIND[list(_v)] = _i + 1
STATS = [*(f"share_{k}" for k in _CLASSES), "word_length", "log_words", "distinct_words", "top_word",
         "symbol_ends", "capital_starts", "words_per_line", "log_chars"]
_END = np.zeros(256, bool)
_END[list(b"!#$%&*@^~=+<>_|")] = True


def structure(w: Words, data: np.ndarray, bucket_counts, chars: np.ndarray) -> np.ndarray:
    """One row of ``STATS`` for each document of a chunk."""
    n, kinds = len(w.first) - 1, len(_CLASSES)
    size = np.diff(w.offsets)
    doc = np.repeat(np.arange(n), size)
    by_kind = np.bincount(doc * (kinds + 1) + _KIND[data], minlength=n * (kinds + 1)).reshape(n, kinds + 1)
    words = np.diff(w.first)
    some = np.maximum(words, 1)
    ends = np.bincount(w.doc, weights=_END[data[w.end - 1]], minlength=n) if len(w.end) else np.zeros(n)
    starts = np.bincount(w.doc, weights=(data[w.start] >= 65) & (data[w.start] < 91), minlength=n) if len(w.end) else np.zeros(n)
    length = np.bincount(w.doc, weights=w.end - w.start, minlength=n) if len(w.end) else np.zeros(n)
    row, _, count = bucket_counts
    distinct = np.bincount(row, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, row, count)
    return np.column_stack([
        by_kind[:, 1:] / np.maximum(size, 1)[:, None], length / some / 10, np.log1p(words), distinct / some, top / some,
        ends / some, starts / some, np.log1p(words / (1 + by_kind[:, 1 + list(_CLASSES).index("line")])), np.log1p(chars)])


def features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words as (row, bucket, weight) and the structure rows of a chunk with ``text`` and ``n_chars``."""
    data, offsets = utf8(part.column("text"))
    w = Words(data, offsets)
    bucket = (w.hash >> np.uint64(48)).astype(np.int64)
    key, count = np.unique(w.doc * np.int64(WORDS) + bucket, return_counts=True)
    row, word = key // WORDS, key % WORDS
    weight = np.log1p(count)
    norm = np.sqrt(np.bincount(row, weights=weight ** 2, minlength=part.num_rows))
    chars = part.column("n_chars").to_numpy(zero_copy_only=False).astype(float)
    return row, word, weight / np.maximum(norm, 1e-9)[row], structure(w, data, (row, word, count), chars)


def rows_of(row, word, weight, stats):
    """Concatenated sparse rows: feature index, value and the start of each row."""
    n, m = stats.shape
    r = np.concatenate([row, np.repeat(np.arange(n), m)])
    i = np.concatenate([word, np.tile(WORDS + np.arange(m), n)])
    x = np.concatenate([weight, stats.ravel()])
    order = np.argsort(r, kind="stable")
    return i[order], x[order], np.searchsorted(r[order], np.arange(n + 1))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -4, 4) / 2

    def parts(self, i, x, start):
        v = self.factors[i] * x[:, None]
        total = np.add.reduceat(v, start[:-1], axis=0)
        square = np.add.reduceat(v * v, start[:-1], axis=0)
        z = self.bias + np.add.reduceat(self.linear[i] * x, start[:-1]) + 0.5 * (total ** 2 - square).sum(axis=1)
        return z, v, total

    def score(self, part: pa.RecordBatch) -> np.ndarray:
        row, word, weight, stats = features(part)
        z, _, _ = self.parts(*rows_of(row, word, weight, self.standard(stats)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], label: np.ndarray, epochs: int = 8,
          rate: float = 0.1, batch: int = 32, seed: int = 0) -> Machine:
    """Logistic loss, AdaGrad steps. ``docs``: (word buckets, weights, statistics) of each text."""
    m = len(STATS)
    stats = np.array([d[2] for d in docs]) if docs else np.zeros((0, m))
    share = float(np.clip(label.mean(), 1e-3, 1 - 1e-3)) if len(label) else 0.5
    rng = np.random.default_rng(seed)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(WORDS + m), np.zeros((WORDS + m, RANK)),
                      stats.mean(axis=0) if docs else np.zeros(m), (stats.std(axis=0) if docs else np.ones(m)) + 1e-6)
    if not docs or label.min() == label.max():
        return machine
    machine.factors = rng.normal(0, 0.05, (WORDS + m, RANK))
    stats = machine.standard(stats)
    g_bias, g_linear, g_factors = 1e-6, np.full(WORDS + m, 1e-6), np.full((WORDS + m, RANK), 1e-6)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
            i, x, start = rows_of(np.concatenate([np.full(len(docs[d][0]), r) for r, d in enumerate(at)]),
                                  np.concatenate([docs[d][0] for d in at]),
                                  np.concatenate([docs[d][1] for d in at]), stats[at])
            z, v, total = machine.parts(i, x, start)
            g = (1 / (1 + np.exp(-z)) - label[at]) / len(at)
            row = np.repeat(np.arange(len(at)), np.diff(start))
            used, back = np.unique(i, return_inverse=True)
            d_linear = np.bincount(back, weights=g[row] * x) + 1e-5 * machine.linear[used]
            d_factors = np.zeros((len(used), RANK))
            np.add.at(d_factors, back, (g[row] * x)[:, None] * (total[row] - v))
            d_factors += 1e-5 * machine.factors[used]
            g_linear[used] += d_linear ** 2
            g_factors[used] += d_factors ** 2
            g_bias += g.sum() ** 2
            machine.linear[used] -= rate * d_linear / np.sqrt(g_linear[used])
            machine.factors[used] -= rate * d_factors / np.sqrt(g_factors[used])
            machine.bias -= rate * g.sum() / np.sqrt(g_bias)
    return machine


def _inputs(docs: DataFrame) -> list:
    length = F.coalesce(F.length("text"), F.lit(0)).cast("double")
    chars = F.coalesce(F.col("n_chars").cast("double"), length) if "n_chars" in docs.columns else length
    return ["text", F.when(chars >= 0, chars).otherwise(length).alias("n_chars")]


def fit(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> Machine:
    """Train on at most ``limit`` labelled documents outside the held-out fold."""
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
             .where(hash_fold("doc_id", 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs(docs))
    # rows that repeat an id are one row of the sample: the one with the least checksum of its text
    rows = (given.join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(
        F.xxhash64("text").alias("key"), "text", "n_chars")).alias("one")).select("doc_id", "quality", "one.text", "one.n_chars"))

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                row, word, weight, stats = features(part)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("quality"),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(word.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(weight)), pa.array(stats.tolist(), pa.list_(pa.float64()))],
                    ["doc_id", "quality", "word", "weight", "stats"])

    got = rows.mapInArrow(run, "doc_id long, quality int, word array<int>, weight array<double>, stats array<double>").toArrow()
    got = got.sort_by([("doc_id", "ascending")])
    docs_ = [(np.array(a.values, np.int64), np.array(b.values, float), np.array(c.values, float))
             for a, b, c in zip(got["word"], got["weight"], got["stats"], strict=True)]
    return train(docs_, got["quality"].to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a fixed size

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(shared.value.score(part))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs(docs)).mapInArrow(
        run, "doc_id long, score double")


def keep(docs: DataFrame, machine: Machine, accept: float = ACCEPT) -> DataFrame:
    """``docs`` without the rows scored below ``accept``; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    given = docs.columns
    chars = "__n_chars"
    while chars in given:
        chars += "_"

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                view = pa.RecordBatch.from_arrays([part.column("text"), part.column(chars)], ["text", "n_chars"])
                good = shared.value.score(view) >= accept
                yield part.select(given).filter(pa.array(good))

    return docs.withColumn(chars, _inputs(docs)[1]).mapInArrow(trimmed(run), docs.schema)
