"""N-gram Jaccard join with PartEnum signatures.

A document's set holds the hashes of its distinct 5-word shingles. Sets lie in
size bands (powers of two); a pair whose sizes allow ``|A n B| / |A u B| >= 0.8``
differs in at most ``H = (1 - t) (a + b) / (1 + t)`` elements. The hash domain is
dealt over second-level parts, two to each first-level part, and the subsets of
one part out of two are enumerated (n2 = 2, k2 = 1): a pair agrees in at least
``parts - H`` of these signatures, so in the first ``H + 1`` of each set under any
common order. A set emits only those, in an order that puts signatures made of
very frequent shingles last, then larger ones first; passages that many
documents share hardly ever become a signature of their own. A set emits
signatures for its own band and, if a partner can lie there, for the next one.

Candidates are not paired within a signature: every set is compared to the
smallest set id (the hub) under each of its signatures, then to the most central
one. Sets that are still in different components though they share a signature
are compared afterwards, in groups of bounded size, by the number of parts in
which they agree and then set by set, so no link between different components
stays unseen. A group gives the links of a spanning forest, never its pairs.
Candidates are verified on whole sets. Equal sets are one class and are never paired.

Edge cases: texts of 1 to 4 words have one shingle, the whole sequence; null,
empty and wordless texts have the empty set and link with nothing; repeated rows
and repeated or null ids belong to the class of their set (a null id is never
the smallest unless alone, then it is the component); empty tables give no
rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import components, deal, groups_of, small, trimmed, written
from quarry.llm.text import Words, chunks, mix, run_hash, utf8

SHINGLE = 5
NUM, DEN = 80, 100  # links: DEN * intersection >= NUM * union
_SLOTS = 20
GROUP = 2048  # classes of a sub-bucket, about
ROUNDS = 1  # comparisons with the centre of a signature before all remaining pairs
SEEN = 1 << 16  # classes of a task whose signatures are not repeated
SCHEME = 63  # low bits of a signature
SET_BYTES = 16 << 20  # sets of a sub-bucket, about


def shingle_sets(w: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a chunk."""
    h, ok = w.grams(k)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(h[a:b - k + 1]))
        elif b > a:
            out.append(run_hash(w.hash[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """64-bit name of a set."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum(dtype=np.uint64) ^ (s * np.uint64(3)).sum(dtype=np.uint64)
                                 + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def max_partner(a: int) -> int:
    return a * DEN // NUM


def distance(a: int, b: int) -> int:
    """Largest symmetric difference of sets of sizes a and b that still link."""
    return (DEN - NUM) * (a + b) // (DEN + NUM)


def parts_of(band: int) -> int:
    """Parts of a band that holds sizes 2 ** band up to 2 ** (band + 1) - 1."""
    top = 2 << band
    return distance(top, top) + 1 + max(1, top // 16)


def part_numbers(s: np.ndarray, scheme: int) -> np.ndarray:
    """Part of each element of a set."""
    parts = np.uint64(parts_of(scheme))
    return ((mix(s ^ np.uint64(scheme + 1)) >> np.uint64(32)) * parts >> np.uint64(32)).astype(np.int64)


#: Half-bytes that are not 0, for every byte.
_DIFFER = np.array([bool(x & 15) + bool(x >> 4) for x in range(256)], np.uint8)


def outline(s: np.ndarray, scheme: int) -> np.ndarray:
    """Half a byte for each part of a scheme; sets that agree in a part agree in it."""
    parts = parts_of(scheme)
    value = np.zeros(parts + parts % 2, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(value, part_numbers(s, scheme), mix(s))
    half = (mix(value) >> np.uint64(60)).astype(np.uint8)
    return half[::2] | half[1::2] << 4


def signatures(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """PartEnum signatures that the set emits; ``hot``: level of each frequency slot."""
    n = len(s)
    band = n.bit_length() - 1
    out = []
    for scheme, partner in ((band, min(max_partner(n), (2 << band) - 1)), (band + 1, max_partner(n))):
        k = distance(n, partner)
        if k < 1 or (scheme > band and partner < 2 << band):
            continue
        parts = parts_of(scheme)
        part = part_numbers(s, scheme)
        order = np.argsort(part, kind="stable")
        size = np.bincount(part, minlength=parts)
        used = np.flatnonzero(size)
        edge = np.concatenate([[0], np.cumsum(size[used])[:-1]])
        value = np.zeros(parts, np.uint64)
        level = np.full(parts, 255, np.int64)
        with np.errstate(over="ignore"):
            value[used] = np.add.reduceat(mix(s[order]), edge)
            level[used] = np.minimum.reduceat(hot[(s[order] >> np.uint64(64 - _SLOTS)).astype(np.int64)], edge)
            name = mix(value + mix(np.arange(parts, dtype=np.uint64) + np.uint64(scheme << 40)))
        name = (name & ~np.uint64(SCHEME)) | np.uint64(scheme)  # a signature tells its scheme
        first = np.lexsort((name, -size, level))[:k + 1]
        out.append(name[first])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _frequent(batches):
    """Per task: documents in each frequency slot, where far above the mean of the task."""
    count = np.zeros(1 << _SLOTS, np.int64)
    docs = 0
    for batch in batches:
        for part in chunks(batch):
            sets = shingle_sets(Words(*utf8(part.column("text"))))
            slots, n = np.unique((np.concatenate(sets) >> np.uint64(64 - _SLOTS)).astype(np.int64), return_counts=True)
            count[slots] += n
            docs += len(sets)
    mean = count.mean()
    at = np.flatnonzero(count > mean + 8 * np.sqrt(mean) + max(8, docs / 500))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["slot", "n"])


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """Level (0: not frequent, else log2 of the documents) of each of 2 ** 20 slots; a fixed size."""
    rows = docs.select("text").mapInArrow(trimmed(_frequent), "slot long, n long").groupBy("slot").agg(F.sum("n")).collect()
    hot = np.zeros(1 << _SLOTS, np.int64)
    for slot, n in rows:
        hot[slot] = int(n).bit_length()
    return hot


def _describe(hot):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(Words(*utf8(part.column("text"))))
                names = [class_of(s) for s in sets]
                sigs = []
                for s, c in zip(sets, names, strict=True):
                    new = len(s) > 0 and c not in seen
                    if new:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(c)
                    sigs.append(signatures(s, hot.value).view(np.int64) if new else np.zeros(0, np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("row"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(names, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sigs), pa.int64()))],
                    ["doc_id", "row", "n_shingles", "cls", "sigs"])
    return run


def _local_star(forward: bool):
    """Pre-aggregation of a batch: one row for each signature with its smallest
    class (``forward``), or the pairs of its other classes with that one."""
    def run(batches):
        for batch in batches:
            lists = batch.column("sigs")
            sig = lists.flatten().to_numpy(zero_copy_only=False)
            cls = np.repeat(batch.column("cls").to_numpy(zero_copy_only=False),
                            np.diff(lists.offsets.to_numpy()))
            if not len(sig):
                continue
            order = np.lexsort((cls, sig))
            sig, cls = sig[order], cls[order]
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            if forward:
                out = {"sig": sig[new], "cls": cls[new]}
            else:
                hub = cls[new][np.cumsum(new) - 1]
                pair = np.unique(np.stack([cls[cls != hub], hub[cls != hub]]), axis=1)
                out = {"a": pair[0], "b": pair[1]}
            yield pa.RecordBatch.from_pydict(out)
    return run


def _verify(batches):
    """The pairs (a, b), given with the texts of both, that link."""
    last, kept = None, None
    for batch in batches:
        for part in chunks(batch, "text_a", 1 << 20):
            left = shingle_sets(Words(*utf8(part.column("text_a"))))
            b, text = part.column("b").to_pylist(), part.column("text_b")
            good = np.zeros(part.num_rows, bool)
            for i, s in enumerate(left):
                if b[i] != last:
                    last, kept = b[i], shingle_sets(Words(*utf8(text.slice(i, 1))))[0]
                both = np.intersect1d(s, kept, assume_unique=True).size
                good[i] = DEN * both >= NUM * (len(s) + len(kept) - both)
            ok = pa.array(good)
            yield pa.RecordBatch.from_arrays([part.column("a").filter(ok), part.column("b").filter(ok)], ["a", "b"])


def _texts_of(names: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``cls, text`` of each named class: any one document stands for its class, its text gives the set again."""
    chosen = written(sets.select("cls", "row").join(names, "cls").groupBy("cls").agg(F.min("row").alias("row")), "chosen")
    return written(docs.join(small(chosen, 16), "row").groupBy("cls").agg(F.min("text").alias("text")), "texts")


def _linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the written ``pairs(a, b)`` of classes that link, by their whole sets."""
    texts = _texts_of(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct(), docs, sets)
    joined = (pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
              .join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b"))
    return written(joined.mapInArrow(trimmed(_verify), "a long, b long"), "links")


def class_links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between classes that connect all classes connected by links."""
    sigs = sets.where("size(sigs) > 0").select("cls", "sigs")
    hubs = sigs.mapInArrow(trimmed(_local_star(True)), "sig long, cls long")
    hubs = hubs.withColumn("hub", F.min("cls").over(Window.partitionBy("sig"))).where("cls <> hub")
    pairs = written(hubs.select(F.col("cls").alias("a"), F.col("hub").alias("b"))
                    .union(sigs.mapInArrow(trimmed(_local_star(False)), "a long, b long")).distinct(), "pairs")
    links = _linked(pairs, docs, sets)

    # every class that shares a signature with another is in `pairs`
    met = written(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct(), "met")
    rest = sigs.join(small(met, 8), "cls").select(F.explode("sigs").alias("sig"), "cls")
    for _ in range(ROUNDS):
        rest = _unresolved(rest, written(components(links), "components"))
        more = written(_to_centre(rest).join(pairs, ["a", "b"], "left_anti"), "more")
        links, pairs = links.union(_linked(more, docs, sets)), pairs.union(more)
    rest = _unresolved(rest, written(components(links), "components"))
    return links.union(_across(rest, docs, sets))


def _unresolved(members: DataFrame, comp: DataFrame) -> DataFrame:
    """The ``members(sig, cls)`` of signatures whose classes lie in several components, with these.

    Components only grow, so signatures that are resolved once stay so."""
    placed = members.select("sig", "cls").join(small(comp.withColumnRenamed("node", "cls"), 16), "cls", "left").select(
        "sig", "cls", F.coalesce("comp", "cls").alias("comp"))
    split = written(placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                    .where("lo < hi").select("sig"), "split")
    return written(placed.join(small(split, 8), "sig").distinct(), "rest")


def _to_centre(rest: DataFrame) -> DataFrame:
    """Pairs of each class with the centre of its signatures: the class that shares
    most signatures with most others, as the original of edited copies does."""
    sizes = rest.groupBy("sig").agg(F.count("*").alias("n"))
    centre = written(rest.join(sizes, "sig").groupBy("cls").agg(F.sum("n").alias("shared"), F.min("comp").alias("comp")),
                     "centre")
    known = rest.select("sig", "cls").join(small(centre, 24), "cls")
    hub = written(known.groupBy("sig").agg(F.max(F.struct("shared", "cls", "comp")).alias("hub")), "hubs")
    return (rest.join(hub, "sig").where("comp <> hub.comp")
            .select(F.greatest("cls", "hub.cls").alias("a"), F.least("cls", "hub.cls").alias("b")).distinct())


def _outlines(batches):
    for batch in batches:
        for part in chunks(batch):
            sets = shingle_sets(Words(*utf8(part.column("text"))))
            band = [len(s).bit_length() - 1 for s in sets]
            yield pa.RecordBatch.from_arrays([
                part.column("cls"), pa.array([len(s) for s in sets], pa.int64()), pa.array(band, pa.int64()),
                pa.array([outline(s, b).tobytes() for s, b in zip(sets, band, strict=True)], pa.binary()),
                pa.array([outline(s, b + 1).tobytes() for s, b in zip(sets, band, strict=True)], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary())],
                ["cls", "size", "band", "own", "next", "shingles"])


def _candidates(rows: pa.Table):
    """Per member of a group the later ones it may link with: of another component, of a size that
    allows it, agreeing in enough parts, and, where ``earlier`` signatures of the scheme are given,
    sharing none of them (they meet there)."""
    size, comp, side, band = (rows[c].to_numpy() for c in ("size", "comp", "side", "band"))
    scheme = int(rows["scheme"][0].as_py())
    lines = np.frombuffer(b"".join(rows["line"].to_pylist()), np.uint8).reshape(len(size), -1)
    earlier = [frozenset(s) for s in rows["earlier"].to_pylist()] if "earlier" in rows.column_names else None
    both = side.any() and not side.all()
    for x in range(len(size) - 1):
        y = np.arange(x + 1, len(size))
        # one of two sets lies in the scheme's own band
        y = y[(comp[y] != comp[x]) & ((band[y] == scheme) | (band[x] == scheme))]
        if both:
            y = y[side[y] != side[x]]
        a, b = size[x], size[y]
        y = y[(NUM * a <= DEN * b) & (NUM * b <= DEN * a)]
        differ = _DIFFER[lines[y] ^ lines[x]].sum(axis=1, dtype=np.int64)
        y = y[differ <= (DEN - NUM) * (a + size[y]) // (DEN + NUM)]
        if earlier:
            y = np.array([j for j in y.tolist() if earlier[x].isdisjoint(earlier[j])], np.int64)
        if len(y):
            yield x, y.tolist()


MEMBER = "grp long, sig long, scheme long, side boolean, cls long, comp long"


def _paired(batches):
    """The members of each group that have a candidate in it."""
    names = [c.split()[0] for c in MEMBER.split(", ")]
    for rows in groups_of(batches):
        some = np.zeros(rows.num_rows, bool)
        for x, y in _candidates(rows):
            some[x] = True
            some[y] = True
        yield from rows.select(names).filter(pa.array(some)).combine_chunks().to_batches()


def _joined(batches):
    """Links between the components of each group that connect what links in it: fewer than members."""
    for rows in groups_of(batches):
        comp, cls = rows["comp"].to_pylist(), rows["cls"].to_pylist()
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"].to_pylist()]
        parent = {c: c for c in comp}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        out = []
        for x, partners in _candidates(rows):
            for y in partners:
                p, q = root(comp[x]), root(comp[y])
                if p != q:
                    both = np.intersect1d(sets[x], sets[y], assume_unique=True).size
                    if DEN * both >= NUM * (len(sets[x]) + len(sets[y]) - both):
                        parent[p] = q
                        out.append((max(cls[x], cls[y]), min(cls[x], cls[y])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


def _across(rest: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between classes of different components that share a signature.

    Groups of a signature hold bounded members and bytes of sets. First the members
    without a candidate leave, told by outlines (linked sets differ in at most H
    elements and so in at most H parts), then those whose candidates all meet in an
    earlier group too; the sets of the rest are compared in place, pairs that are
    joined already are skipped, and only the links of a spanning forest come out.
    No pair leaves a group otherwise."""
    texts = _texts_of(rest.select("cls").distinct(), docs, sets)
    lines = written(texts.mapInArrow(
        trimmed(_outlines), "cls long, size long, band long, own binary, next binary, shingles binary"), "outlines")
    most = f"least({GROUP}, greatest(16, shiftright({SET_BYTES >> 4}, cast(sig & {SCHEME} as int))))"
    dealt = deal(rest.select("sig", "cls", "comp"), ["sig"], "cls", most).withColumn("scheme", F.expr(f"sig & {SCHEME}L"))
    line = F.when(F.col("band") == F.col("scheme"), F.col("own")).otherwise(F.col("next")).alias("line")
    names = [c.split()[0] for c in MEMBER.split(", ")]

    def grouped(rows, *more):
        return rows.join(lines, "cls").select(*names, "size", "band", line, *more).repartition("grp").sortWithinPartitions("grp")

    some = written(grouped(dealt).mapInArrow(trimmed(_paired), MEMBER), "paired")
    held = rest.groupBy("cls").agg(F.collect_set("sig").alias("sigs"))  # no more than a set emits
    earlier = F.expr(f"filter(sigs, x -> x < sig and (x & {SCHEME}L) = scheme)")
    first = written(grouped(some.join(held, "cls").withColumn("earlier", earlier), "earlier").mapInArrow(
        trimmed(_paired), MEMBER), "first")
    chosen = first.join(held, "cls").withColumn("earlier", earlier)
    return written(grouped(chosen, "earlier", "shingles").mapInArrow(trimmed(_joined), "a long, b long"), "joined")


def _placed(docs: DataFrame) -> DataFrame:
    """``doc_id, row, n_shingles, comp`` for every row of ``docs(doc_id, text, row)``; ``comp`` names the component."""
    hot = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs))
    sets = written(docs.select("doc_id", "row", "text").mapInArrow(
        trimmed(_describe(hot)), "doc_id long, row long, n_shingles long, cls long, sigs array<long>"), "sets")
    comp = written(components(class_links(docs, sets)), "classes")
    return sets.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select(
        "doc_id", "row", "n_shingles", F.coalesce("comp", "cls").alias("comp"))


def _named(docs: DataFrame) -> DataFrame:
    # a row's name covers id and text: rows that repeat an id with another text stay apart
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "row", F.xxhash64("doc_id", "text"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    placed = _placed(_named(docs))
    least = written(placed.where("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("least")), "least")
    return placed.join(least, "comp", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
        .alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component (the smallest id); empty sets all stay, all columns stay."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    placed = written(_placed(_named(docs)).where("n_shingles > 0").select("doc_id", "row", "comp"), "placed")
    first = written(placed.groupBy("comp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")), "first")
    gone = written(placed.join(first, "comp").where("row <> first.row").select("row").distinct(), "gone")
    again = written(placed.groupBy("row").count().where("count > 1").select("row"), "again")
    marked = docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), "text"))

    def without(frame: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        return frame.join(small(rows.withColumnRenamed("row", name), 8), name, how)

    kept = without(marked, gone, "left_anti")
    if not again.isEmpty():  # rows that occur more than once
        kept = without(kept, again, "left_anti").unionByName(
            without(kept, again, "left_semi").dropDuplicates([name]))
    return kept.select(docs.columns)
