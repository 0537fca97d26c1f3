"""SentencePiece encoding and decoding (BPE models with byte fallback) by suffix-array matching.

A chunk of texts is cut where no piece can reach across (before spaces, around
characters that no piece holds); its distinct parts are concatenated and indexed
by a suffix array. Every piece of the vocabulary is binary-searched for the range
of its occurrences, which gives all edges (from, to, piece) of the
segmentation graph; the edges are sorted by position and relaxed from left to
right. A merge-based encoding is the one path on which every two neighbouring
pieces are compatible, i.e. merging the pair on its own gives the pair back; so
each node keeps the one piece that ends there, and an edge is taken if its piece
is compatible with the piece kept at its start. Compatibility is read off the
merge trees: the merge across the boundary must never come before the merges that
build the two pieces.

Parts are kept for the task's next chunks (up to ``KEPT``), so that each is
encoded once. Characters without a piece become bytes. Runs of several spaces,
whose pieces all share one score, are merged with a priority queue.

The model file is read on the driver; a table of its pieces (a fixed size) is
shipped. Nothing is trained.

Edge cases: a null text has null ids and null round_trip; an empty text has no
pieces; U+2581 reads as a space, as in the library, so such a text does not
round-trip; repeated rows and ids are encoded row by row; an empty table gives
no rows; very long texts are encoded whole; further columns are ignored by
``encode``.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import trimmed
from quarry.llm.text import chunks, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
KEPT = 500_000
FAR = np.int64(1 << 40)
_PROBE = "  a ＡﬁÅ \t b́ "


class Vocabulary:
    """Pieces, merge ranks, merge trees and the pairs that merge."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        if sp.normalize(_PROBE) != SPACE + _PROBE.replace(" ", SPACE):
            raise ValueError("only models without normalisation, with a space put in front, are supported")
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = np.full(256, -1, np.int64)
        pieces: dict[str, int] = {}
        for i, p in enumerate(names):
            if sp.is_byte(i):
                self.bytes[int(p[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[p] = i
        if (self.bytes < 0).any():
            raise ValueError("only models with byte fallback are supported")
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece reaches across a space")
        self.pieces, self.names = pieces, names
        score = {p: sp.get_score(i) for p, i in pieces.items()}
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank_of = {p: ranks[s] for p, s in score.items()}
        self.size = n
        # -1: a single character, present from the start
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        reachable = []
        for p, i in pieces.items():
            if len(p) == 1:
                reachable.append(p)
            elif self.merge(p) == [p]:
                self.rank[i] = self.rank_of[p]
                a, b = self._last
                self.left[i], self.right[i] = pieces[a], pieces[b]
                reachable.append(p)
        pairs = sorted((pieces[p[:c]] * n + pieces[p[c:]], self.rank_of[p]) for p in pieces if len(p) > 1
                       for c in range(1, len(p)) if p[:c] in pieces and p[c:] in pieces)
        self.pair = np.array([k for k, _ in pairs], np.int64)
        self.pair_rank = np.array([r for _, r in pairs], np.int64)
        # pieces as search keys: two non-zero bytes for each character
        chars = sorted({c for p in reachable for c in p})
        self.code = np.zeros(0x110000, np.uint16)
        for k, c in enumerate(chars):
            self.code[ord(c)] = (k // 255 + 1) << 8 | (k % 255 + 1)
        reachable = [p for p in reachable if not p.startswith(SPACE * 2)]
        self.width = max(map(len, reachable))
        self.match = np.array([pieces[p] for p in reachable], np.int64)
        self.length = np.array([len(p) for p in reachable], np.int64)
        raw = [b"".join(int(self.code[ord(c)]).to_bytes(2, "big") for c in p) for p in reachable]
        self.low = np.array(raw, f"S{2 * self.width}")
        self.high = np.array([r.ljust(2 * self.width, b"\xff") for r in raw], f"S{2 * self.width}")
        known = set(chars)
        loose = re.escape("".join(c for c in "\n\r\t\x0b\x0c\x00" if c not in known))
        self.cut = re.compile(f"{SPACE}+[^{SPACE}{loose}]*|[^{SPACE}{loose}]+|[{loose}]" if loose
                              else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        plain = [b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        for b, i in enumerate(self.bytes):
            plain[i] = bytes([b])
        self.out = np.frombuffer(b"".join(plain), np.uint8)
        self.out_at = np.concatenate([[0], np.cumsum([len(x) for x in plain])])

    def merge(self, text: str) -> list[str]:
        """Merge-based encoding of one string with a priority queue (characters without a piece stay)."""
        sym, n = list(text), len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self.rank_of.get(sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (r, i, sym[i] + sym[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i] if sym[i] else n
            if j >= n or sym[i] + sym[j] != whole:
                continue
            self._last = (sym[i], sym[j])
            sym[i], sym[j], after[i] = whole, "", after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s in sym if s]

    def compatible(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether merging piece u followed by piece t leaves both as they are."""
        ok = np.ones(len(u), bool)
        at = np.arange(len(u))
        x, y = u.copy(), t.copy()
        above_x, above_y = np.full(len(u), FAR), np.full(len(u), FAR)
        while len(at):
            key = x * self.size + y
            i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            m = np.where(self.pair[i] == key, self.pair_rank[i], FAR)
            # of equal ranks the left one merges first
            across = (m < FAR) & (m < above_x) & (m <= above_y)
            ok[at[across]] = False
            go = ~across & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            at, x, y, above_x, above_y = at[go], x[go], y[go], above_x[go], above_y[go]
            late = self.rank[x] > self.rank[y]
            above_x, above_y = np.where(late, self.rank[x], above_x), np.where(late, above_y, self.rank[y])
            x, y = np.where(late, self.right[x], x), np.where(late, y, self.left[y])
        return ok


def encode_parts(v: Vocabulary, parts: list[str]) -> list[np.ndarray]:
    """Piece ids of each distinct part of a chunk."""
    text = "\0".join(parts) + "\0"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(p) for p in parts])
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    n = len(points)
    code = v.code[points]
    code[first + size] = 0
    part = np.repeat(np.arange(len(parts)), size + 1)

    # suffix array: suffixes by their first `width` characters
    padded = np.concatenate([code, np.zeros(v.width, np.uint16)]).astype(">u2")
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, v.width)[:n])
    own = np.flatnonzero(code)
    keys = keys[own].view(f"S{2 * v.width}").ravel()
    order = np.argsort(keys, kind="stable")
    suffix, keys = own[order], keys[order]

    # occurrence ranges of every piece, as edges
    lo, hi = np.searchsorted(keys, v.low, "left"), np.searchsorted(keys, v.high, "right")
    count = hi - lo
    start = suffix[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - lo, count)]
    piece, length = np.repeat(v.match, count), np.repeat(v.length, count)
    odd = np.flatnonzero((code == 0) & (np.arange(n) != (first + size)[part]))
    start = np.concatenate([start, odd])
    piece = np.concatenate([piece, np.full(len(odd), -1)])
    length = np.concatenate([length, np.ones(len(odd), np.int64)])

    # edges by position within their part, then relaxed position by position in all parts at once
    offset = start - first[part[start]]
    order = np.argsort(offset.astype(np.uint16) if not len(offset) or offset.max() < 1 << 16 else offset, kind="stable")
    start, piece, length, offset = start[order], piece[order], length[order], offset[order]
    last = np.full(n + 1, -3, np.int64)  # -3: not reached, -2: start of a part, -1: a character without a piece
    last[first] = -2
    back = np.zeros(n + 1, np.int64)
    steps = np.searchsorted(offset, np.arange(int(offset[-1]) + 2 if len(offset) else 1))
    for a, b in zip(steps[:-1], steps[1:], strict=True):
        s, t = start[a:b], piece[a:b]
        u = last[s]
        good = u > -3
        both = np.flatnonzero((u >= 0) & (t >= 0))
        if len(both):
            pair, inverse = np.unique(u[both] * v.size + t[both], return_inverse=True)
            good[both] = v.compatible(pair // v.size, pair % v.size)[inverse]
        end = s[good] + length[a:b][good]
        last[end], back[end] = t[good], s[good]

    # the path of each part, walked back from its end
    on_path = np.zeros(n + 1, bool)
    at, who = first + size, np.arange(len(parts))
    while len(who):
        on_path[at] = True
        at = back[at]
        go = at > first[who]
        at, who = at[go], who[go]
    node = np.flatnonzero(on_path)
    who = part[node - 1]
    ids = last[node]
    cut = np.searchsorted(who, np.arange(len(parts) + 1))
    out = [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    for p in np.unique(who[ids < 0]):
        a, b = cut[p], cut[p + 1]
        out[p] = np.concatenate([ids[i:i + 1] if ids[i] >= 0 else
                                 v.bytes[list(chr(int(points[node[i] - 1])).encode("utf-8", "surrogatepass"))] for i in range(a, b)])
    return out


class Encoder:
    """Encodes chunks of texts; parts seen are kept."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def _add(self, parts: list[str]) -> None:
        plain = [p for p in parts if not p.startswith(SPACE * 2)]
        spaced = [p for p in parts if p.startswith(SPACE * 2)]
        ids = encode_parts(self.v, plain) if plain else []
        for p in spaced:
            ids.append(np.array([i for s in self.v.merge(p) for i in (
                [self.v.pieces[s]] if s in self.v.pieces else self.v.bytes[list(s.encode())])], np.int64))
        for p in (*plain, *spaced):
            self.index[p] = len(self.index)
        self.flat = np.concatenate([self.flat, *ids]).astype(np.int32)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in ids])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's begin."""
        if len(self.index) > KEPT:
            self._clear()
        cut = self.v.cut.findall
        parts = [cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set().union(*parts).difference(self.index)
        if new:
            self._add(sorted(new))
        get = self.index.__getitem__
        n = np.array([len(p) for p in parts], np.int64)
        which = np.fromiter(map(get, chain.from_iterable(parts)), np.int64, int(n.sum()))
        size = self.at[which + 1] - self.at[which]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.at[which] - total[:-1], size)]
        return ids, total[np.concatenate([[0], np.cumsum(n)])]


def decode(v: Vocabulary, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of id sequences and where each begins; the space put in front is taken off."""
    size = v.out_at[ids + 1] - v.out_at[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    data = v.out[np.arange(total[-1]) + np.repeat(v.out_at[ids] - total[:-1], size)]
    begin = total[start]
    keep = np.ones(len(data), bool)
    some = begin[:-1][begin[1:] > begin[:-1]]
    keep[some[data[some] == 32]] = False
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[begin]


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, ids, n_tokens, round_trip`` for every row of ``docs``; ``round_trip``: decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches):
        v = shared.value
        coder = Encoder(v)
        for batch in batches:
            for part in chunks(batch):
                column = part.column("text")
                ids, start = coder.encode(column.fill_null("").to_pylist())
                data, begin = decode(v, ids, start)
                given, offsets = utf8(column)
                same = np.diff(begin) == np.diff(offsets)
                for d in np.flatnonzero(same):
                    same[d] = np.array_equal(data[begin[d]:begin[d + 1]], given[offsets[d]:offsets[d + 1]])
                null = column.is_null()
                lists = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(ids, pa.int32()))
                if column.null_count:
                    import pyarrow.compute as pc
                    lists = pc.if_else(null, pa.scalar(None, lists.type), lists)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), lists, pa.array(np.diff(start)),
                    pa.array(same, mask=null.to_numpy(zero_copy_only=False))], ["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").mapInArrow(
        trimmed(run), "doc_id long, ids array<int>, n_tokens long, round_trip boolean")
