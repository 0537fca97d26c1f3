"""Secret scans: fixed patterns, and character Markov models of random strings.

Base spans are the leftmost non-overlapping matches of three patterns (fixed
values, below). Further spans come from first-order character Markov models:
one of ordinary identifiers, and one for each alphabet that keys are drawn from.
A run of 20 or more key characters that holds a digit and a letter and touches
no base span is a secret if its log-likelihood ratio (best random model against
identifiers) reaches ``PER_CHAR`` for each character.

Training samples are labelled by the base patterns over all documents: values
they match are random strings, other runs of 8 or more key characters are
identifiers. Uniform strings of each alphabet (``PRIOR`` seeded ones) are added
to the random class, so that an alphabet without a match has a model as well.
Only tables of character pairs leave the tasks.

Edge cases: a null text counts as empty and has no span; offsets are code points
with the end excluded; repeated rows are scanned one by one; ids may be null; an
empty table gives no rows; very long texts are read whole; further columns are
ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import trimmed
from quarry.llm.text import chunks, spans_of, utf8

# The patterns, least lengths and their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

ADDED = "markov"
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}=*")
PER_CHAR = 1.0
FLAT = 0.03
LEAN = 1000
PRIOR = 400
ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
_CHARS = ALPHABETS["mixed"] + "_-="
SIZE = len(_CHARS) + 1  # 0: any other character
_CODE = np.zeros(256, np.int64)
_CODE[list(_CHARS.encode())] = np.arange(1, SIZE)
_KEY = np.zeros(256, bool)
_KEY[list(_CHARS.encode())] = True
_KEY[ord("=")] = False
_HEXADECIMAL = np.zeros(256, bool)
_HEXADECIMAL[list(b"0123456789abcdef")] = True

Span = tuple[str, int, int]


def base_spans(text: str, hexadecimal: bool = True) -> tuple[list[Span], list[str]]:
    """Spans of the fixed patterns in order of start and kind, and the values they hold."""
    found, values = [], []
    low = text.lower()
    if any(x in low for x in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                found.append(("assign", *m.span()))
                values.append(m[2])
    for kind, pattern, maybe in (("access", ACCESS, "AKIA" in text), ("hex", HEX, hexadecimal)):
        if maybe:
            for m in pattern.finditer(text):
                if len(m[0]) >= LEAST[kind]:
                    found.append((kind, *m.span()))
                    values.append(m[0])
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))), values


def _with_run(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, least: int) -> np.ndarray:
    """Which documents of a chunk hold a run of ``least`` member bytes."""
    start, end, doc = spans_of(member[data], offsets)
    hit = np.zeros(len(offsets) - 1, bool)
    hit[doc[end - start >= least]] = True
    return hit


def pair_counts(values: list[str]) -> np.ndarray:
    """Counts of neighbouring characters, with the start of a value as code 0."""
    count = np.zeros((SIZE, SIZE))
    for v in values:
        c = _CODE[np.frombuffer(v.encode("utf-8", "replace"), np.uint8)]
        np.add.at(count, (np.concatenate([[0], c[:-1]]), c), 1)
    return count


def alphabet_of(value: str) -> str:
    chars = set(value)
    return next((k for k, a in ALPHABETS.items() if chars <= set(a)), "mixed")


def _train(batches):
    """Pair counts of identifiers and of each random alphabet over a task's documents."""
    total = {k: np.zeros((SIZE, SIZE)) for k in ("word", *ALPHABETS)}
    for batch in batches:
        for part in chunks(batch):
            data, offsets = utf8(part.column("text"))
            hexadecimal = _with_run(data, offsets, _HEXADECIMAL, LEAST["hex"])
            member = _KEY[data]
            for d, text in enumerate(part.column("text").to_pylist()):
                spans, values = base_spans(text or "", bool(hexadecimal[d]))
                for v in values:
                    total[alphabet_of(v)] += pair_counts([v])
                for _, a, b in spans:
                    lo = offsets[d] + len(text[:a].encode())
                    member[lo:lo + len(text[a:b].encode())] = False
            start, end, _ = spans_of(member, offsets)
            long = end - start >= 8
            edge = np.zeros(len(data) + 1, np.int8)
            np.add.at(edge, start[long], 1)
            np.add.at(edge, end[long], -1)
            word = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
            code = _CODE[data]
            before = np.zeros(len(data), np.int64)
            before[1:] = np.where(word[:-1], code[:-1], 0)
            before[start[long]] = 0
            total["word"] += np.bincount((before * SIZE + code)[word], minlength=SIZE * SIZE).reshape(SIZE, SIZE)
    for k, c in total.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at), pa.array(c.ravel()[at])],
                                         ["model", "pair", "n"])


class Models:
    """Logarithms of transition probabilities: identifiers and each random alphabet."""

    def __init__(self, counts: dict[str, np.ndarray], seed: int = 0):
        rng = np.random.default_rng(seed)
        log = {}
        for k in ("word", *ALPHABETS):
            c = counts.get(k, np.zeros((SIZE, SIZE))).astype(float)
            if k != "word":
                # labelled values weigh no more than the uniform ones: few real keys must not fix the pairs
                c *= min(1.0, PRIOR * 32 / max(c.sum(), 1))
                letters = list(ALPHABETS[k])
                c += pair_counts(["".join(rng.choice(letters, 32)) for _ in range(PRIOR)])
            # rare first characters lean on the frequencies of all, so that a key seen once teaches nothing;
            # a share of the uniform law bounds what one unseen pair can weigh, at every size of the corpus
            every = (c.sum(axis=0) + 1) / (c.sum() + SIZE)
            c = (c + LEAN * every) / (c.sum(axis=1, keepdims=True) + LEAN)
            log[k] = np.log((1 - FLAT) * c + FLAT / SIZE)
        self.word = log["word"]
        self.random = [log[k] for k in ALPHABETS]

    def ratio(self, run: str) -> float:
        """Log-likelihood ratio of a run, for each character."""
        c = _CODE[np.frombuffer(run.encode("ascii", "replace"), np.uint8)]
        a = np.concatenate([[0], c[:-1]])
        return (max(m[a, c].sum() for m in self.random) - self.word[a, c].sum()) / max(1, len(c))

    def added(self, text: str, base: list[Span]) -> list[Span]:
        out = []
        for m in RUN.finditer(text):
            a, b = m.span()
            s = m[0]
            if (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
                    and not any(x < b and a < y for _, x, y in base) and self.ratio(s) >= PER_CHAR):
                out.append((ADDED, a, b))
        return out


def train(docs: DataFrame) -> Models:
    counts = {k: np.zeros(SIZE * SIZE) for k in ("word", *ALPHABETS)}
    # SIZE * SIZE pairs of each model at most
    for k, pair, n in docs.select("text").mapInArrow(_train, "model string, pair long, n double").groupBy(
            "model", "pair").agg(F.sum("n")).collect():
        counts[k][pair] = n
    return Models({k: c.reshape(SIZE, SIZE) for k, c in counts.items()})


def _spans(part: pa.RecordBatch, models: Models):
    """(text, base spans, all spans) of each row of a chunk."""
    data, offsets = utf8(part.column("text"))
    hexadecimal = _with_run(data, offsets, _HEXADECIMAL, LEAST["hex"])
    keys = _with_run(data, offsets, _KEY, 20)
    order = (*KINDS, ADDED)
    for d, text in enumerate(part.column("text").to_pylist()):
        text = text or ""
        base, _ = base_spans(text, bool(hexadecimal[d]))
        more = models.added(text, base) if keys[d] else []
        yield text, base, sorted([*base, *more], key=lambda s: (s[1], order.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, models: Models) -> DataFrame:
    """``doc_id``, the number of base spans by kind, of added spans, and the spans, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # a fixed size

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                found = list(_spans(part, shared.value))
                count = [[sum(s[0] == k for s in every) for _, _, every in found] for k in (*KINDS, ADDED)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), *(pa.array(c, pa.int64()) for c in count),
                    pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for _, b, _ in found], pa.string()),
                    pa.array([joined(every) for _, _, every in found], pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redact(docs: DataFrame, models: Models, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; a column ``n_chars`` follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                texts, sizes = part.column("text").to_pylist(), None
                if "n_chars" in part.schema.names:
                    sizes = part.column("n_chars").to_pylist()
                for d, (text, _, spans) in enumerate(_spans(part, shared.value)):
                    if spans:
                        out, at = [], 0
                        for _, a, b in spans:
                            if a >= at:
                                out.append(text[at:a] + mark)
                            at = max(at, b)
                        texts[d] = "".join(out) + text[at:]
                        if sizes is not None:
                            sizes[d] = len(texts[d])
                columns = {n: part.column(n) for n in part.schema.names}
                columns["text"] = pa.array(texts, part.schema.field("text").type)
                if sizes is not None:
                    columns["n_chars"] = pa.array(sizes, part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(trimmed(run), schema)
