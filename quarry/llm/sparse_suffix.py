"""Repeated passages by sparse suffix arrays.

Of all suffixes (a suffix starts at a word) only those at minimiser positions
are kept: the k-gram with the smallest hash in some run of ``WINDOW``
neighbouring k-grams. A passage of ``MIN_WORDS`` words that occurs twice has the
same first minimiser in both places, at most ``WINDOW - 1`` words from its
start, so both suffixes agree in at least ``MIN_WORDS - WINDOW + 1`` words.

1. Kept suffixes are grouped by a hash of that prefix; those whose prefix is in
   another text too are matches, all others are dropped. This replaces the sort
   of a suffix array: suffixes that agree in the prefix would be neighbours
   there, in order or not, and the length compared is fixed, so no order among
   them is needed and nothing is compared across partition borders.
2. Matches are extended right to ``MIN_WORDS`` words. Consecutive suffixes that
   hold out cover everything between them.
3. Where that chain does not reach ``WINDOW - 1`` words to the left of a suffix in
   some text, the passages that begin before the suffix (left extension of 1 to
   ``WINDOW - 1`` words) are compared in all texts that match there.

The union of all passages found is returned; it equals the words covered by any
run of ``MIN_WORDS`` words that occurs in two different texts. Grouping is by
64-bit hashes of words, and equal texts are taken once and reported as whole
copies, so neither large groups of copies nor common passages meet in one task.

Edge cases: words are runs of non-white-space bytes, A-Z counting as a-z; texts
below ``MIN_WORDS`` words, empty and null texts have no passage; a passage that
repeats only inside one document is not reported; a row that occurs again is a
copy; ids may be null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import small, written
from quarry.llm.text import Words, chunks, utf8

MIN_WORDS = 50
K = 5
WINDOW = 20


def minimisers(w: Words, k: int = K, window: int = WINDOW) -> np.ndarray:
    """Positions with the (leftmost) smallest k-gram of some ``window`` k-grams of one document."""
    h, ok = w.grams(k)
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    whole = np.flatnonzero(ok[:n] & ok[window - 1:] & (w.doc[:n] == w.doc[window - 1:]))
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    picked = [whole[i:i + 65536] + view[whole[i:i + 65536]].argmin(axis=1) for i in range(0, len(whole), 65536)]
    return np.unique(np.concatenate(picked)) if picked else whole


def _suffixes(min_words: int):
    prefix = min_words - WINDOW + 1

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                w = Words(*utf8(part.column("text")))
                at = minimisers(w)
                stop = w.first[w.doc[at] + 1]
                at, stop = at[at + prefix <= stop], stop[at + prefix <= stop]
                full = np.where(at + min_words <= stop,
                                w.runs(np.minimum(at, len(w.hash) - min_words), min_words).view(np.int64)
                                if len(w.hash) >= min_words else 0, 0)
                t = part.column("t").to_numpy(zero_copy_only=False)[w.doc[at]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(t), pa.array((at - w.first[w.doc[at]]).astype(np.int32)),
                    pa.array(w.runs(at, prefix).view(np.int64)),
                    pa.array(full, mask=at + min_words > stop)], ["t", "pos", "prefix", "full"])
    return run


def _left(min_words: int):
    """Passages that begin up to WINDOW - 1 words before one of the positions ``pos``."""
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                w = Words(*utf8(part.column("text")))
                lists = part.column("pos")
                pos = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                begin, stop = w.first[doc], w.first[doc + 1]
                edge = np.zeros(len(w.hash) + 1, np.int32)
                np.add.at(edge, np.maximum(begin, begin + pos - WINDOW + 1), 1)
                np.add.at(edge, np.minimum(begin + pos + 1, stop), -1)
                s = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                doc = w.doc[s]
                s, doc = s[s + min_words <= w.first[doc + 1]], doc[s + min_words <= w.first[doc + 1]]
                if len(s):
                    t = part.column("t").to_numpy(zero_copy_only=False)[doc]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(t), pa.array((s - w.first[doc]).astype(np.int32)),
                        pa.array(w.runs(s, min_words).view(np.int64))], ["t", "pos", "key"])
    return run


def _merge(min_words: int):
    """Start positions of repeated passages of each text to spans [start, end)."""
    def run(batches):
        for batch in batches:
            t, out = batch.column("t").to_pylist(), ([], [], [])
            for d, pos in enumerate(batch.column("pos").to_pylist()):
                pos = np.unique(pos)
                new = np.concatenate([[True], pos[1:] > pos[:-1] + min_words])
                last = np.concatenate([np.flatnonzero(new)[1:], [len(pos)]]) - 1
                out[0].extend([t[d]] * int(new.sum()))
                out[1].extend(pos[new].tolist())
                out[2].extend((pos[last] + min_words).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())],
                ["t", "first_word", "end_word"])
    return run


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur in two different texts."""
    return rows.groupBy(key).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo < hi").select(key)


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, first_word, end_word, n_words, whole_copy``: the maximal spans of each
    document that repeated passages of ``min_words`` words or more cover."""
    if min_words < WINDOW + K:
        raise ValueError(f"min_words must be {WINDOW + K} or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(
        {"t": F.xxhash64("text"), "row": F.xxhash64("doc_id", "text")})
    suffixes = docs.select("t", "text").mapInArrow(
        _suffixes(min_words), "t long, pos int, prefix long, full long")
    matched = written(suffixes.join(written(_shared(suffixes, "prefix"), "prefixes"), "prefix").distinct(), "matched")
    held = written(_shared(matched.where("full is not null"), "full"), "held")
    marked = matched.join(held.withColumn("held", F.lit(True)), "full", "left").withColumn(
        "held", F.coalesce("held", F.lit(False)))
    upto = Window.partitionBy("t").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("held"), F.col("pos"))).over(upto.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("last", last).withColumn("start", F.max(F.when(
        F.col("held") & (F.col("last").isNull() | (F.col("pos") - F.col("last") > min_words)), F.col("pos"))).over(upto))
    # all passages that begin before a chained suffix lie in words that its chain covers
    marked = written(marked.withColumn("chained", F.col("held") & (F.col("pos") - F.col("start") >= WINDOW - 1)).drop(
        "last", "start"), "marked")
    # where the chain is open in one text, its partners are asked too
    asked = written(marked.where("not chained").select("prefix").distinct(), "asked")
    lists = written(marked.join(asked, "prefix").groupBy("t").agg(F.collect_list("pos").alias("pos")), "lists")
    # one document stands for all with its text
    chosen = written(docs.select("t", "row").join(lists.select("t"), "t").groupBy("t").agg(F.min("row").alias("row")),
                     "chosen")
    listed = written(chosen.join(lists, "t"), "listed")
    # the rows first, so that only texts with a match are shuffled if their lists are too large to broadcast
    asked_docs = docs.select("row", "text").join(small(listed.select("row"), 16), "row", "left_semi")
    open_ends = written(asked_docs.join(small(listed, 64, "pos"), "row").select("t", "text", "pos").mapInArrow(
        _left(min_words), "t long, pos int, key long"), "open")
    starts = (open_ends.join(written(_shared(open_ends, "key"), "keys"), "key").select("t", "pos")
              .union(marked.where("held").select("t", "pos")))
    spans = starts.groupBy("t").agg(F.collect_set("pos").alias("pos")).mapInArrow(
        _merge(min_words), "t long, first_word long, end_word long")

    copies = docs.select("t", "text").groupBy("t").agg(F.count("*").alias("n"), F.min(F.length("text")).alias("chars"))
    copied = written(copies.where(f"n > 1 and chars >= {2 * min_words - 1}").select("t"), "copied")
    words = (docs.select("row", "t", "text").join(small(written(
        docs.select("t", "row").join(copied, "t").groupBy("t").agg(F.min("row").alias("row")), "copies").select("row"), 8),
        "row").mapInArrow(_word_counts, "t long, n long").distinct().where(f"n >= {min_words}"))
    whole = words.select("t", F.lit(0).cast("long").alias("first_word"), F.col("n").alias("end_word"),
                         F.lit(True).alias("whole_copy"))
    found = written(spans.join(whole.select("t"), "t", "left_anti").withColumn("whole_copy", F.lit(False))
                    .union(whole), "spans")
    return docs.select("doc_id", "t").join(found, "t").select(
        "doc_id", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), "whole_copy")


def _word_counts(batches):
    for batch in batches:
        for part in chunks(batch):
            w = Words(*utf8(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("t"), pa.array(np.diff(w.first), pa.int64())], ["t", "n"])
