"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Every word n-gram of a test item is a seed, rare or not: an edit leaves no say
   in which ones stay intact, and those of an item that was often copied are all
   frequent.
2. Documents are joined to items on the seeds. The words around the hits of a
   pair bound its score from above (match 2 for each word that the item has at
   all, else -1, best run); pairs whose bound stays below the threshold go, which
   holds off the company of frequent n-grams and drops no result. "Around" reaches
   as far as an alignment of the least score can, ``reach`` words on each side.
3. The item is aligned with the words that are left (match 2, mismatch -1,
   gap -1). A pair is reported if the best local score reaches ``threshold`` of
   the item's own.

A copy that shares no ``SEED`` words in a row with its item (edited at every
third word or closer) has no seed and is not found, whatever its score.

Items come in blocks of bounded size. A block's seeds are shipped to the tasks and
its results written before the next block is read, so driver and tasks hold one
block at a time; each block reads the documents once. Texts are not shuffled,
unless ``clean`` has several blocks and too many texts to drop for a broadcast.

Edge cases: texts are compared in lower case; words are runs of bytes other than
ASCII white space and punctuation; an item of fewer than ``SEED`` words is its own
seed; null, empty or wordless texts and items match nothing; repeated documents
and repeated items are each reported; ids may be null; empty tables give no
rows; further columns of both tables are ignored by ``matches`` and kept by
``clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small, trimmed, written
from quarry.llm.text import PUNCTUATED, Words, chunks, mix, utf8

SEED = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's own score. Unrelated texts of one language stay near 0.2.
THRESHOLD = 0.5
BLOCK_BYTES = 4 << 20
_BITS = 20
_ROWS = 1 << 18  # hits, or words around hits, looked at together

SCHEMA = ("doc_id long, item_id long, score long, coverage double, "
          "first_word long, last_word long, item_words long")


def words_of(column: pa.Array) -> Words:
    return Words(*utf8(pc.utf8_lower(column.cast(pa.large_string()))), PUNCTUATED)


class Lookup:
    """Positions of known hashes in an array: a bitmap first, then binary search."""

    def __init__(self, known: np.ndarray):
        self.known = np.unique(known)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self._slot(self.known)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, h: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(ok & self.bits[self._slot(h)])
        if not len(at):
            return at, at
        i = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        good = self.known[i] == h[at]
        return at[good], i[good]


class Items:
    """A block of test items as word hashes, with their n-grams."""

    def __init__(self, ids: list, texts: list):
        w = words_of(pa.array(texts, pa.string()))
        self.ids = ids
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        size = np.diff(w.first)
        parts = []
        for k in range(1, SEED + 1):
            h, ok = w.grams(k)
            at = np.flatnonzero(ok & ((size[w.doc] == k) if k < SEED else True))
            parts.append((h[at], w.doc[at], at - w.first[w.doc[at]], np.full(len(at), k)))
        self.hash, self.item, self.offset, self.k = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.sizes = sorted({int(x) for x in np.unique(self.k)})
        owner = np.repeat(np.arange(len(self.words)), size)
        self.held = Lookup(_pair(owner, w.hash))


def _pair(item: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Name of an item's word."""
    return mix(word ^ mix(item.astype(np.uint64)))


def align(items: np.ndarray, windows: np.ndarray, item_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local scores of item i with window i, and the window position each ends at.

    ``items`` (P, m) and ``windows`` (P, n) hold word hashes; items are padded
    beyond ``item_len``, windows are padded with 0.
    """
    p, n = windows.shape
    col = np.arange(n, dtype=np.int32)
    h = np.zeros((p, n + 1), np.int32)
    best, end = np.zeros(p, np.int32), np.zeros(p, np.int64)
    for i in range(items.shape[1]):
        same = (windows == items[:, i:i + 1]) & (windows != 0)
        t = np.maximum(h[:, :-1] + np.where(same, MATCH, MISMATCH).astype(np.int32), h[:, 1:] + GAP)
        np.maximum(t, 0, out=t)
        t = np.maximum.accumulate(t - GAP * col, axis=1) + GAP * col
        t[i >= item_len] = 0
        h[:, 1:] = t
        at = t.argmax(axis=1)
        top = t[np.arange(p), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


def _align_all(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """``align`` over (item, window) pairs of any lengths, in padded groups of bounded size."""
    score, end = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][1]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * (len(pairs[order[hi]][1]) + 1) <= cells:
            hi += 1
        own = [pairs[i] for i in order[lo:hi]]
        m, n = max(len(a) for a, _ in own), max(len(b) for _, b in own)
        left, right = np.zeros((len(own), m), np.uint64), np.zeros((len(own), n), np.uint64)
        for r, (a, b) in enumerate(own):
            left[r, :len(a)], right[r, :len(b)] = a, b
        s, e = align(left, right, np.array([len(a) for a, _ in own]))
        score[order[lo:hi]], end[order[lo:hi]] = s, e
        lo = hi
    return score, end


def _hits(w: Words, lookups: list[tuple[int, Lookup]]):
    for k, known in lookups:
        h, ok = w.grams(k)
        yield k, *known.find(h, ok)


def _bounds(w: Words, items: Items, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """No alignment of item i with the words [first, last) of window i scores more than this."""
    n = last - first
    bound = np.zeros(len(n), np.int64)
    group = np.cumsum(n) // _ROWS
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        size = n[own]
        start = np.cumsum(size) - size
        window = np.repeat(np.arange(len(own)), size)
        word = w.hash[np.arange(size.sum()) - start[window] + first[own][window]]
        gain = np.full(len(word), max(MISMATCH, GAP), np.int64)
        gain[items.held.find(_pair(item[own][window], word), np.ones(len(word), bool))[0]] = MATCH
        after = np.cumsum(gain)
        # windows lie so far apart that the least sum before a word is one of its own window
        apart = window * (2 * MATCH * (len(word) + 1))
        least = np.minimum.accumulate(after - gain - apart) + apart
        bound[own] = np.maximum.reduceat(after - least, start)
    return bound


def reach(m: np.ndarray | int, threshold: float):
    """Words that an alignment of the least score can take in besides the item's ``m``: each costs a gap."""
    return np.ceil((1 - threshold) * MATCH * m / -GAP).astype(np.int64) + 2


def scan(w: Words, items: Items, lookups, starts, entries, threshold: float):
    """Aligned pairs of a chunk: (document index, item index, score, first and last word).

    Hits are taken in runs of about ``_ROWS`` in order of their place, also within a
    document; the windows around the hits of a run hold every alignment through them."""
    hits = [(at, starts[k][i], starts[k][i + 1] - starts[k][i]) for k, at, i in _hits(w, lookups)]
    if not hits:
        return []
    at, start, n = (np.concatenate(x) for x in zip(*hits, strict=True))
    if not len(at):
        return []
    order = np.argsort(at, kind="stable")
    at, start, n = at[order], start[order], n[order]
    cut = np.flatnonzero(np.diff((np.cumsum(n) - n) // _ROWS)) + 1
    found: dict[tuple[int, int], tuple] = {}
    for a, b in zip(np.r_[0, cut], np.r_[cut, len(at)], strict=True):
        size = n[a:b]
        which = np.repeat(at[a:b], size)
        entry = entries[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start[a:b], size)]
        for row in _aligned(w, items, w.doc[which], items.item[entry], which - items.offset[entry], threshold):
            known = found.get(row[:2])
            if known is None or (-row[2], row[4]) < (-known[2], known[4]):  # the first of the best
                found[row[:2]] = row
    return [found[key] for key in sorted(found)]


def _aligned(w: Words, items: Items, doc: np.ndarray, item: np.ndarray, diag: np.ndarray, threshold: float):
    """``scan`` of some hits."""
    order = np.lexsort((diag, item, doc))
    doc, item, diag = doc[order], item[order], diag[order]
    length = np.array([len(x) for x in items.words])
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
                         | (diag[1:] - diag[:-1] > length[item[1:]])) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(doc)]]) - 1
    doc, item, m = doc[lo], item[lo], length[item[lo]]
    first = np.maximum(w.first[doc], diag[lo] - reach(m, threshold))
    last = np.minimum(w.first[doc + 1], diag[hi] + m + reach(m, threshold))
    own = np.flatnonzero(_bounds(w, items, item, first, last) >= threshold * MATCH * m)
    doc, item, m, origin = doc[own], item[own], m[own], first[own]
    pairs = [(items.words[i], w.hash[a:b]) for i, a, b in zip(item, origin, last[own], strict=True)]
    score, end = _align_all(pairs)
    best: dict[tuple[int, int], int] = {}
    for j in np.flatnonzero(score >= threshold * MATCH * m):
        key = (int(doc[j]), int(item[j]))
        if key not in best or score[j] > score[best[key]]:
            best[key] = j
    chosen = sorted(best.items())
    _, back = _align_all([(pairs[j][0][::-1], pairs[j][1][:end[j] + 1][::-1]) for _, j in chosen])
    return [(d, i, int(score[j]), int(origin[j] + end[j] - back[x] - w.first[d]), int(origin[j] + end[j] - w.first[d]))
            for x, ((d, i), j) in enumerate(chosen)]


def _scanner(items: Items, threshold: float):
    lookups, starts, entries = [], {}, np.zeros(0, np.int64)
    for k in items.sizes:
        at = np.flatnonzero(items.k == k)
        known = Lookup(items.hash[at])
        slot = np.searchsorted(known.known, items.hash[at])
        order = np.argsort(slot, kind="stable")
        starts[k] = len(entries) + np.searchsorted(slot[order], np.arange(len(known.known) + 1))
        entries = np.concatenate([entries, at[order]])
        lookups.append((k, known))
    return lambda w: scan(w, items, lookups, starts, entries, threshold)


def _blocks(benchmark: DataFrame):
    """Items of each block of the benchmark, read one at a time, and whether it is the only one."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    for b in range(blocks):
        own = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        items = Items([r[0] for r in own], [r[1] for r in own])
        if len(items.hash):
            yield items, blocks == 1


def _block_matches(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    find = _scanner(items, threshold)

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                rows = find(words_of(part.column("text")))
                if rows:
                    ids = part.column("doc_id").to_pylist()
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[r[0]] for r in rows], pa.int64()),
                        pa.array([items.ids[r[1]] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([r[2] / (MATCH * len(items.words[r[1]])) for r in rows], pa.float64()),
                        pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
                        pa.array([len(items.words[r[1]]) for r in rows], pa.int64())],
                        ["doc_id", "item_id", "score", "coverage", "first_word", "last_word", "item_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item that align, with the best alignment's score and words."""
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for items, alone in _blocks(benchmark):
        own = _block_matches(docs, items, threshold)
        found = own if alone else found.union(written(own, "aligned"))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text aligns with a test item; all columns stay."""
    bad = None
    for items, alone in _blocks(benchmark):
        if alone:
            return _block_clean(docs, items, threshold)
        # a text's name takes the place of its document's id, so rows with the same text go together
        own = written(_block_matches(docs.select(F.xxhash64("text").alias("doc_id"), "text"), items, threshold)
                      .select("doc_id").distinct(), "aligned")
        bad = own if bad is None else bad.union(own)
    if bad is None:
        return docs
    name = "__aligned"
    while name in docs.columns:
        name += "_"
    bad = written(bad.distinct().select(F.col("doc_id").alias(name)), "bad")
    return docs.withColumn(name, F.xxhash64("text")).join(small(bad, 16), name, "left_anti").select(docs.columns)


def _block_clean(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    find = _scanner(items, threshold)

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                keep = np.ones(part.num_rows, bool)
                keep[[r[0] for r in find(words_of(part.column("text")))]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(trimmed(run), docs.schema)
