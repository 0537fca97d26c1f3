"""Merkle manifest of a dataset, indexed by bitmaps of document ids.

Every document is a leaf (SHA-256 of its fields, each with its length). Per source,
leaves in order of ``doc_id`` form a tree of runs of 16, its root is the source's
subroot; the subroots, in order of the sources, form a tree of the same kind up to
the root. ``H`` is lowercase hex SHA-256 of concatenated hex digests.

A leaf's place comes from a bitmap index and no sort of the leaves:

1. ids of a source are set in 64-bit words; the words of all tasks merge by
   ``bit_or`` (partial words before the shuffle). Eight words make a container,
   which keeps only its non-zero words, told by a byte, and a popcount directory
   (ids before each kept word). Ids that several leaves hold are listed with their
   number of leaves;
2. counts of containers add up along their order in ranges (one task per range,
   then range totals), not in one task per source;
3. the rank of an id is: leaves before its container + directory + popcount of the
   bits below it + leaves beyond the first of listed ids below it.

Then keyed slot arrays reduce the levels: (source, slot div 16) collects at most 16
(slot, digest) structs. Levels are written tables; paths go down the levels by joins
of runs with their parents. No step gathers a source, and the driver takes only the
root and the number of levels.

Edge cases: fields that are null count as ``-``; a null source is a source of its
own, first in order, a null id comes before all ids; rows that share source and id
are ordered by leaf, and equal rows (any number) take consecutive slots, one each;
a source of one leaf has that leaf as subroot, one source's subroot is the root; an
empty table gives no rows; further columns are ignored. Rows with a null id are never
tampered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import small, written

FAN = 16
WORD, WORDS = 6, 3  # a word holds 2 ** 6 ids, a container 2 ** 3 words
_NO_ID = -(1 << 58)  # word of null ids: before that of every id
_COPIES = 4096  # equal rows that one row stands for when they are dealt out
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def record(text: Column) -> Column:
    """A leaf: the digest of doc_id, source, lang, n_chars and ``text``."""
    def field(value):
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))


def stratum(source: str = "source") -> Column:
    """Source as text that is never null and keeps the order, null first."""
    return F.coalesce(F.concat(F.lit("1"), F.col(source)), F.lit("0"))


def leaves(docs: DataFrame) -> DataFrame:
    """``stratum, doc_id, leaf, other, n``: distinct leaves with their number of rows.

    ``other`` is the leaf of the tampered row, where one document in five (by the
    checksum of its id) has its text lower-cased, else null."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select(
        stratum().alias("stratum"), F.col("doc_id").cast("long").alias("doc_id"), record(F.col("text")).alias("leaf"),
        F.when(hit, record(F.translate("text", UPPER, LOWER))).alias("other"),
    ).groupBy("stratum", "doc_id", "leaf", "other").agg(F.count("*").alias("n"))


# --- bitmap index ---------------------------------------------------------------------------

def ahead(rows: DataFrame, weight: str, order: list[str], within: list[str]) -> DataFrame:
    """``rows`` with ``ahead``: the weights of the rows before, in ``order``, of the same ``within``; and their ``total``.

    Rows are ranged and written with the number of their range; sums within a range
    and totals of ranges give the rest. A hot ``within`` spans many ranges."""
    ranged = written(rows.repartitionByRange(*[F.asc_nulls_first(c) for c in within + order])
                     .withColumn("range", F.spark_partition_id()), "ranged")
    by = Window.partitionBy(*within).orderBy("range")
    base = ranged.groupBy("range", *within).agg(F.sum(weight).alias("held")).select(
        "range", *within, (F.sum("held").over(by) - F.col("held")).alias("base"),
        F.sum("held").over(Window.partitionBy(*within)).alias("total"))
    inner = Window.partitionBy("range", *within).orderBy(*[F.asc_nulls_first(c) for c in order])
    inside = ranged.withColumn("inside", F.sum(weight).over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    return (inside.join(small(written(base, "bases"), 64), ["range", *within])
            .withColumn("ahead", F.col("base") + F.coalesce("inside", F.lit(0))).drop("range", "inside", "base"))


def _addressed(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("word", F.expr(f"coalesce(shiftright(doc_id, {WORD}), {_NO_ID}L)"))
            .withColumn("bit", F.expr(f"cast(coalesce(doc_id & {(1 << WORD) - 1}, 0) as int)"))
            .withColumn("box", F.expr(f"shiftright(word, {WORDS})")))


def bitmap_index(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Containers of the ids of ``rows(stratum, doc_id, n)``, and the words in which an id has several leaves."""
    at = _addressed(rows)
    words = written(at.groupBy("stratum", "box", "word").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.sum("n").alias("n")), "words")
    crowded = written(words.where("n > bit_count(bits)").select("stratum", "word"), "crowded")
    listed = (at.join(small(crowded, 64), ["stratum", "word"], "left_semi")
              .groupBy("stratum", "box", "word", "bit").agg(F.sum("n").alias("n")).where("n > 1"))
    nth = f"cast(word & {(1 << WORDS) - 1} as int)"
    again = listed.groupBy("stratum", "box").agg(
        F.expr(f"collect_list(struct({nth} * {1 << WORD} + bit as at, n - 1 as more))").alias("again"))
    boxes = (words.groupBy("stratum", "box").agg(
        F.sum("n").alias("n"), F.expr(f"sort_array(collect_list(struct({nth} as nth, bits)))").alias("kept"))
        .selectExpr("stratum", "box", "n", "aggregate(kept, 0, (a, x) -> a | shiftleft(1, x.nth)) as mask",
                    "kept.bits as words")
        .withColumn("directory", F.expr(
            "transform(words, (x, i) -> aggregate(slice(words, 1, i), 0, (a, y) -> a + bit_count(y)))")))
    return ahead(boxes.join(again, ["stratum", "box"], "left"), "n", ["box"], ["stratum"]).drop("n"), crowded


def ranked(rows: DataFrame) -> DataFrame:
    """Distinct leaves with the first slot each takes in its source, and the source's number of leaves (``width``)."""
    boxes, crowded = bitmap_index(rows)
    found = (_addressed(rows).join(boxes, ["stratum", "box"])
             .withColumn("low", F.expr(f"cast(word & {(1 << WORDS) - 1} as int) * {1 << WORD} + bit"))
             .withColumn("k", F.expr(f"bit_count(mask & (shiftleft(1, low div {1 << WORD}) - 1))"))
             .withColumn("slot", F.expr(
                 "ahead + element_at(directory, k + 1) + bit_count(element_at(words, k + 1) & ~shiftleft(-1L, bit))"
                 " + coalesce(aggregate(filter(again, x -> x.at < low), 0L, (a, x) -> a + x.more), 0)"))
             .withColumn("tied", F.expr("coalesce(exists(again, x -> x.at = low), false)"))
             .select("stratum", "doc_id", "leaf", "other", "n", "slot", F.col("total").alias("width"), "tied"))
    if crowded.isEmpty():
        return found.drop("tied")
    # leaves of one id, in order of the leaf
    tied = ahead(found.where("tied"), "n", ["leaf"], ["stratum", "slot"])
    tied = tied.withColumn("slot", F.col("slot") + F.col("ahead")).drop("ahead", "total")
    return found.where("not tied").unionByName(tied).drop("tied")


# --- levels ----------------------------------------------------------------------------------

def _closed(runs: DataFrame) -> DataFrame:
    """Runs ``(tree, run, width, members, digest)``; a tree of one node is its own digest."""
    return runs.withColumn("digest", F.when(F.col("width") == 1, F.col("members")[0]["digest"]).otherwise(
        F.sha2(F.array_join("members.digest", ""), 256)))


def leaf_runs(placed: DataFrame) -> DataFrame:
    """The runs of leaves of every source; equal rows take a slot each."""
    piece = placed.where(f"n <= {_COPIES}")
    many = placed.where(f"n > {_COPIES}").withColumn("c", F.expr(f"explode(sequence(0L, (n - 1) div {_COPIES}))"))
    many = many.selectExpr("stratum", "doc_id", "leaf", "other", f"least({_COPIES}, n - c * {_COPIES}) as n",
                           f"slot + c * {_COPIES} as slot", "width").repartition("stratum", "slot")
    runs = piece.unionByName(many).withColumn("run", F.expr(
        f"explode(sequence(slot div {FAN}, (slot + n - 1) div {FAN}))")).selectExpr(
        "stratum as tree", "run", "width", f"greatest(slot, run * {FAN}) as at",
        f"least(slot + n, run * {FAN} + {FAN}) as end", "leaf", "other", "doc_id")
    members = F.expr("flatten(transform(sort_array(collect_list(struct(at, end, leaf, other, doc_id))), p -> transform("
                     "sequence(p.at, p.end - 1), s -> struct(s as slot, p.leaf as digest, p.other as other, p.doc_id as doc_id))))")
    return _closed(runs.groupBy("tree", "run", "width").agg(members.alias("members")))


def climb(first: DataFrame) -> list[DataFrame]:
    """All levels above (and with) the written runs of leaves."""
    levels = [first]
    while True:
        above = levels[-1].select("tree", F.col("run").alias("slot"), "digest",
                                  F.expr(f"(width + {FAN - 1}) div {FAN}").alias("width")).where("width > 1")
        runs = above.groupBy("tree", F.expr(f"slot div {FAN}").alias("run"), "width").agg(
            F.sort_array(F.collect_list(F.struct("slot", "digest"))).alias("members"))
        runs = written(_closed(runs), "level")
        if runs.isEmpty():
            return levels
        levels.append(runs)


def tops(levels: list[DataFrame]) -> list[DataFrame]:
    """Per level the digests of the trees that end there: ``tree, run, digest``."""
    return [level.where(f"width <= {FAN}").select("tree", "run", "digest") for level in levels]


def _beside(members: str = "members") -> Column:
    """Members of a run, each with the digests left and right of it joined."""
    def joined(test):
        return lambda one: F.array_join(F.transform(
            F.filter(members, lambda m: test(m["slot"], one["slot"])), lambda m: m["digest"]), "")

    left, right = joined(lambda m, one: m < one), joined(lambda m, one: m > one)
    return F.transform(members, lambda one: F.struct(
        one.alias("one"), F.struct(left(one).alias("left"), right(one).alias("right")).alias("beside")))


def descend(levels: list[DataFrame], crown: DataFrame | None = None) -> DataFrame:
    """The leaf level's members with their paths: ``tree, one, path, subroot``.

    A path lists, from the leaf up, what stands left and right of each node in its
    run; ``crown(tree, path)`` continues it above the trees' tops."""
    ends = tops(levels)
    above = None
    for i in reversed(range(len(levels))):
        top = ends[i].withColumnRenamed("digest", "subroot")
        none = F.expr("cast(array() as array<struct<left: string, right: string>>)")
        top = top.join(crown, "tree") if crown is not None else top.withColumn("path", none)
        parents = top.select("tree", "run", "path", "subroot")
        if above is not None:
            parents = parents.union(above)
        inside = (levels[i].join(parents, ["tree", "run"])
                  .select("tree", "width", "path", "subroot", F.explode(_beside()).alias("m"))
                  .withColumn("path", F.when(F.col("width") == 1, F.col("path")).otherwise(
                      F.concat(F.array("m.beside"), F.col("path")))))
        if i == 0:
            return inside.select("tree", "m.one", "path", "subroot")
        above = inside.select("tree", F.col("m.one.slot").alias("run"), "path", "subroot")


def fold(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, source, leaf, other, path, subroot, root`` of every row of ``docs``; ``other`` as in ``leaves``."""
    placed = ranked(written(leaves(docs), "leaves"))
    trees = climb(written(leaf_runs(placed), "runs"))
    ends = [t.select("tree", "digest") for t in tops(trees)]
    subroots = written(union_of(ends), "subroots")
    numbered = ahead(subroots.withColumn("one", F.lit(1).cast("long")), "one", ["tree"], [])
    sources = numbered.selectExpr(
        "'' as tree", f"ahead div {FAN} as run", "total as width", "struct(ahead as slot, digest, tree as source) as m")
    crown = climb(written(_closed(sources.groupBy("tree", "run", "width").agg(
        F.sort_array(F.collect_list("m")).alias("members"))), "sources"))
    root = union_of([t.select("digest") for t in tops(crown)]).first()
    over = written(descend(crown).select(F.col("one.source").alias("tree"), "path"), "crown")
    return descend(trees, over).select(
        F.col("one.doc_id").alias("doc_id"), F.when(F.col("tree") != "0", F.expr("substring(tree, 2)")).alias("source"),
        F.col("one.digest").alias("leaf"), F.col("one.other").alias("other"), "path", "subroot",
        F.lit(root[0] if root else None).cast("string").alias("root"))


def union_of(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def proofs(entries: DataFrame) -> DataFrame:
    """Digest of each proof, and the root that the (tampered) leaf folds to."""
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    folded = fold(F.col("path"), F.coalesce("other", "leaf"))
    return entries.select(
        "doc_id", "source", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
