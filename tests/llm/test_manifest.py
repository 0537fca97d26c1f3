"""Merkle manifest: against a tree built in plain Python, and the awkward cases."""

import hashlib
import zlib
from collections import Counter

import pytest

from quarry.llm import manifest
from tests.llm.helpers import empty, frame, messy

UP = str.maketrans(manifest.UPPER, manifest.LOWER)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def reduce_tree(nodes):
    """Top, and for each node its path [(left, right), ...]."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        for k, i in enumerate(at):
            run = runs[i // 16]
            paths[k].append(("".join(run[:i % 16]), "".join(run[i % 16 + 1:])))
            at[k] = i // 16
        nodes = [H(*r) for r in runs]
    return nodes[0], paths


def by_hand(rows):
    per = {}
    for doc_id, text, lang, source, n_chars in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        lowered = None if text is None else text.translate(UP)
        leaf = leaf_of(doc_id, text, lang, source, n_chars)
        used = leaf_of(doc_id, lowered, lang, source, n_chars) if hit else leaf
        per.setdefault(source, []).append(((doc_id is not None, doc_id), leaf, used))
    order = sorted(per, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: reduce_tree([leaf for _, leaf, _ in sorted(per[s])]) for s in order}
    root, over = reduce_tree([trees[s][0] for s in order])
    out = Counter()
    for s, above in zip(order, over, strict=True):
        for ((_, doc_id), leaf, used), path in zip(sorted(per[s]), trees[s][1], strict=True):
            h = used
            for left, right in path + above:
                h = H(left, h, right)
            out[doc_id, s, leaf, trees[s][0], root, H(*(x for p in path + above for x in p)), h, h == root] += 1
    return out


def check(spark, rows, df=None):
    got = manifest.proofs(manifest.manifest(frame(spark, rows) if df is None else df)).collect()
    assert Counter(map(tuple, got)) == by_hand(rows)
    return got


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [257, 1, 16], [300] + [3] * 20])
def test_trees_of_many_shapes(spark, sizes):
    rows = [(100_000 * s + 37 * i, f"Text {s} {i}", "en", f"src{s}", i) for s, n in enumerate(sizes) for i in range(n)]
    got = check(spark, rows)
    # every tampered document is caught, every other stands
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 5 != 0) for r in got)


def test_deep_tree_and_dense_ids(spark):
    check(spark, [(i, f"t{i}", "en", "hot", i) for i in range(4200)])


def test_sparse_and_negative_ids(spark):
    ids = [0, -1, -64, -65, -512, -513, 63, 64, 511, 512, 2 ** 62, -2 ** 62, 2 ** 63 - 1, -2 ** 63, 5 ** 20, None]
    check(spark, [(d, f"A{d}", "en", "s", 1) for d in ids])


def test_awkward(spark):
    rows = [tuple(r[:5]) for r in messy(spark).collect()]
    check(spark, rows, messy(spark))
    assert manifest.proofs(manifest.manifest(empty(spark))).count() == 0


def test_repeated_rows_and_ids(spark):
    rows = [(1, "Same", "en", "a", 4)] * 5000 + [(1, f"Other {i}", "en", "a", 4) for i in range(40)]
    rows += [(None, f"x{i % 7}", None, None, None) for i in range(50)] + [(2, "End", "en", "a", 3), (0, "Begin", "en", "a", 3)]
    check(spark, rows)


def test_source_order_is_bytewise(spark):
    check(spark, [(i, "T", "en", s, 1) for i, s in enumerate([None, "", "a", "B", "é", "漢", "😀", "￮", "-", "0", "1"] * 3)])


def test_bitmap_ranks_equal_positions(spark):
    ids = sorted({(i * i * 7919) % 50_000 - 20_000 for i in range(3000)})
    rows = spark.createDataFrame([("1s", i, f"{i:x}", None, 1) for i in ids],
                                 "stratum string, doc_id long, leaf string, other string, n long")
    got = manifest.ranked(rows).collect()
    assert {r.doc_id: r.slot for r in got} == {d: k for k, d in enumerate(ids)}
    assert {r.width for r in got} == {len(ids)}
