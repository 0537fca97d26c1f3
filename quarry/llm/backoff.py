"""Corpus language-model scores: stupid backoff over n-gram count tables.

Documents are scored by an n-gram model (``order`` words, 3 by default) of all
*other* documents: counts of the document itself are taken off, so a score tells
how well the rest of the corpus predicts it. With c the remaining counts, N the
remaining words and n the order, a word is scored by the longest n-gram that ends
with it and that the others hold, of k words:

    S = ALPHA ** (n - k) * c(k-gram) / c(its first k - 1 words)     (c of none: N)
    S = ALPHA ** n / N                                              if they do not hold the word

Log scores are summed per document.

1. Every block of texts is exploded into n-grams, counted within the block, and
   sent to the count tables, which are partitioned by n-gram hash.
2. A partition adds up its n-grams and joins the totals back to the blocks'
   rows. One row holds all n-grams of a block in one partition, in hash order, so
   only totals go back and hot n-grams cost one entry per block.
3. Blocks meet their totals and sum the scores of their documents.

A block's rows are a run of rows in the order in which ``docs`` is read; both
reads must agree (files or a written table do), which is checked.

Edge cases: words are runs of non-white-space bytes, A-Z counting as a-z; null,
empty and wordless texts have no words, log score 0 and no mean; a text that
occurs again is predicted by its copy; with no other words every S is ALPHA ** 2;
ids may be null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import give_back, trimmed
from quarry.llm.text import Words, chunks, mix, utf8

ALPHA = 0.4
ORDER = 3
MAX_PARTS = 1 << 14  # so that a block's rows grow with its n-grams, not with the corpus
BLOCK = 6 << 20  # bytes of text in a block
SLICE = 16 << 20  # bytes of text for each partition of the tables


def name_of(part: pa.RecordBatch) -> int:
    """Name of a run of rows, by their contents and order."""
    with np.errstate(over="ignore"):
        ids = part.column("row").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        total = (mix(ids) * np.arange(1, 2 * len(ids), 2, dtype=np.uint64)).sum(dtype=np.uint64)
        return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _squeezed(raw: bytes, level: int = 1) -> bytes:
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def _opened(raw: bytes) -> bytes:
    return pa.decompress(raw[4:], int.from_bytes(raw[:4], "little"), codec="zstd", asbytes=True)


def packed(n: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs (the first byte says how many),
    the low bytes of all before the next ones, compressed: the high bytes are nearly all 0."""
    size = max(1, -(-int(n.max()).bit_length() // 8)) if len(n) else 1
    planes = np.ascontiguousarray(n, "<u8").view(np.uint8).reshape(len(n), 8)[:, :size].T
    return bytes([size]) + _squeezed(planes.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    size, planes = raw[0], np.frombuffer(_opened(raw[1:]), np.uint8)
    out = np.zeros((len(planes) // size, 8), np.uint8)
    out[:, :size] = planes.reshape(size, -1).T
    return out.view("<u8").ravel()


def names_packed(grams: np.ndarray) -> bytes:
    """Sorted distinct names as their steps."""
    return packed(np.diff(grams, prepend=grams.dtype.type(0)))


def names_unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


def names_of(part: pa.RecordBatch, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct names of the n-grams of a run of texts, and their counts: all that the tables need."""
    w = Words(*utf8(part.column("text")))
    names = [w.hash]
    for k in range(2, order + 1):
        gram, ok = w.grams(k)
        names.append(gram[ok])
    del w
    grams = np.concatenate(names)
    del names
    grams.sort()
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]][:len(grams)])
    return grams[first], np.diff(first, append=len(grams))


class Block:
    """Words of a run of texts, and its n-grams of each length by hash."""

    def __init__(self, part: pa.RecordBatch, order: int):
        self.words = w = Words(*utf8(part.column("text")))
        names, at = [w.hash], [np.arange(len(w.hash))]
        for k in range(2, order + 1):
            gram, ok = w.grams(k)
            at.append(np.flatnonzero(ok).astype(np.int64))
            names.append(gram[ok])
        cut = np.cumsum([0, *map(len, names)])
        self.grams, inverse = np.unique(np.concatenate(names), return_inverse=True)
        self.counts = np.bincount(inverse, minlength=len(self.grams))
        #: places of n-grams of each length, by their first word, and their numbers there
        self.at, self.of = at, [inverse[x:y].astype(np.int32) for x, y in zip(cut[:-1], cut[1:], strict=True)]



def bounds_of(parts: int) -> np.ndarray:
    return (np.arange(parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)


def _explode(parts: int, order: int):
    def run(batches):
        bounds = bounds_of(parts)
        for batch in batches:
            for part in chunks(batch, limit=BLOCK):
                grams, counts = names_of(part, order)
                # first n-gram of each table partition (hash ranges of equal width)
                cut = np.append(np.searchsorted(grams, bounds), len(grams))
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(some), name_of(part))), pa.array(some.astype(np.int32)),
                    pa.array([names_packed(grams[cut[p]:cut[p + 1]] - bounds[p]) for p in some], pa.binary()),
                    pa.array([packed(counts[cut[p]:cut[p + 1]]) for p in some], pa.binary())],
                    ["block", "slice", "grams", "counts"])
    return run


def _totals(rows: pa.Table) -> pa.Table:
    """Totals of a table partition, in the order of each block's n-grams."""
    out = _total(rows)
    give_back()
    return out


def _total(rows: pa.Table) -> pa.Table:
    grams = [names_unpacked(x.as_py()) for x in rows["grams"]]
    counts = np.concatenate([unpacked(x.as_py()) for x in rows["counts"]])
    _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(inverse, weights=counts).astype(np.int64)[inverse]
    cut = np.cumsum([0, *(len(g) for g in grams)])
    return pa.table({"block": rows["block"], "slice": rows["slice"],
                     "totals": pa.array([packed(total[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})


def _stored(texts: pa.Array) -> bytes:
    """A column of texts as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("text", texts.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([texts], ["text"]))
    return _squeezed(sink.getvalue().to_pybytes(), 3)


def _read(raw: bytes) -> pa.Array:
    return pa.ipc.open_stream(_opened(raw)).read_all()["text"].combine_chunks()


def _texts(batches):
    """Blocks as single rows: the texts and ids of each."""
    for batch in batches:
        for part in chunks(batch, limit=BLOCK):
            yield pa.RecordBatch.from_arrays([
                pa.array([name_of(part)], pa.int64()), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([part.column("row").to_pylist()], pa.list_(pa.int64())),
                pa.array([_stored(part.column("text"))], pa.binary())], ["block", "doc_id", "row", "text"])


def score_block(b: Block, total: np.ndarray, n_words: int, order: int) -> pd.DataFrame:
    """Log scores of a block's documents, given the corpus totals of its n-grams; ``n_k``: words scored by k-grams."""
    w = b.words
    n_docs = len(w.first) - 1
    size = np.diff(w.first)
    left = np.maximum(n_words - size, 1)[w.doc]
    s = ALPHA ** order / left
    used = np.zeros(len(s), np.int8)
    context = left  # remaining count of the k - 1 words that begin at a place
    for k in range(1, order + 1):
        at, of = b.at[k - 1], b.of[k - 1]
        # an n-gram's total without its document's own
        _, back, own = np.unique(w.doc[at] * np.int64(len(b.grams) + 1) + of, return_inverse=True, return_counts=True)
        rest = total[of] - own[back]
        hit = np.flatnonzero(rest > 0)
        last = at[hit] + k - 1
        s[last] = ALPHA ** (order - k) * rest[hit] / context[at[hit]]
        used[last] = k
        if k < order:
            context = np.zeros(len(s), np.int64)
            context[at] = rest
    found = {"n_words": size}
    for k in range(2, order + 1):
        found[f"n_{k}"] = np.bincount(w.doc[used == k], minlength=n_docs)
    found["log_score"] = np.bincount(w.doc, weights=np.log(s), minlength=n_docs) if len(s) else np.zeros(n_docs)
    return pd.DataFrame(found)


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id, n_words, n_2 ... n_order, log_score, mean_log`` for every row of ``docs``;
    ``n_k``: words that an n-gram of k words scores."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row"))

    def words(batches):
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([
                    pa.array([len(Words(*utf8(part.column("text"))).hash)]),
                    pa.array([part.column("text").nbytes])], ["words", "bytes"])

    size = docs.select("text").mapInArrow(trimmed(words), "words long, bytes long").agg(F.sum("words"), F.sum("bytes")).first()
    n_words, parts = size[0] or 0, min(MAX_PARTS, max(1, math.ceil((size[1] or 0) * order / (2 * SLICE))))

    tables = docs.select("text", "row").mapInArrow(
        trimmed(_explode(parts, order)), "block long, slice int, grams binary, counts binary")
    totals = tables.groupBy("slice").applyInArrow(_totals, "block long, slice int, totals binary")
    blocks = docs.mapInArrow(trimmed(_texts), "block long, doc_id array<long>, row array<long>, text binary")

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        out = joined(left, right)
        give_back()
        return out

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i in range(left.num_rows):
            part = pa.RecordBatch.from_arrays(
                [_read(left["text"][i].as_py()), pa.array(left["row"][i].as_py(), pa.int64())], ["text", "row"])
            b = Block(part, order)
            if right.num_rows == 0 and len(b.grams):
                raise ValueError("docs came in another order in its second read; write it to a table first")
            # equal runs of rows share a name, and so their totals
            _, firsts = np.unique(right["slice"].to_numpy(), return_index=True)
            total = np.concatenate([np.zeros(0, np.int64), *(unpacked(right["totals"][int(j)].as_py()).astype(np.int64)
                                                             for j in firsts)])
            found = score_block(b, total, n_words, order)
            found.insert(0, "doc_id", pd.array(left["doc_id"][i].as_py(), "Int64"))
            out.append(pa.Table.from_pandas(found, preserve_index=False))
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in counts), ("log_score", pa.float64())])
        return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()

    counts = ["n_words", *(f"n_{k}" for k in range(2, order + 1))]
    found = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        join, ", ".join(["doc_id long", *(f"{c} long" for c in counts), "log_score double"]))
    return found.withColumn("mean_log", F.expr("log_score / nullif(n_words, 0)"))
