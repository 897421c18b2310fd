from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from keyvigil.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string, ids string"


def plain(rows, parts=4, entries=256, rounds=4):
    """Lloyd by trying every entry for every part, in Python's whole numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    width = -(-max(len(r[1]) for r in kept) // parts)
    most = vector_codes.limit(width)
    whole = [[max(-most, min(most, math.floor(1024 * x))) for x in r[1]] + [0] * (width * parts - len(r[1])) for r in kept]
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assigned():
        return [[min(range(len(book)), key=lambda e: (far(c[p], book[e]), e)) for p, book in enumerate(books)] for c in cut]

    for _ in range(rounds):
        found = assigned()
        for p in range(parts):
            for e in range(len(order)):
                own = [c[p] for c, f in zip(cut, found) if f[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = assigned()
    error = [sum(far(c[p], books[p][f[p]]) for p in range(parts)) for c, f in zip(cut, found)]
    by_label = {}
    for r, e in zip(kept, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return [(r[0], "".join(f"{x:02x}" for x in f), e, by_label[r[2]], digest) for r, f, e in zip(kept, found, error)]


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)
    columns = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return [tuple(r) for r in vector_codes.compressed(frame, **options).select(*columns).collect()]


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def vectors(rng, n, width=16, kinds=7):
    centres = rng.normal(0, 0.4, (kinds, width))
    return [(int(i), (centres[i % kinds] + rng.normal(0, 0.05, width)).tolist(), int(i % 3)) for i in range(n)]


def test_given_vectors(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in given]
    assert same(found(spark, rows), plain(rows))


@pytest.mark.parametrize("entries", [3, 16])
def test_trees_deeper_than_one_leaf(spark, monkeypatch, entries):
    monkeypatch.setattr(vector_codes, "LEAF", 4)
    monkeypatch.setattr(vector_codes, "PAIR_VALUES", 64)
    rows = vectors(np.random.default_rng(1), 400)
    assert same(found(spark, rows, entries=entries), plain(rows, entries=entries))


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = vectors(rng, 60)
    rows += [(100, None, 1), (101, [1.0, None] * 8, 1), (102, [math.nan] * 16, 1), (103, [math.inf] * 16, 2), (104, [], 1),
             (105, [0.25, -0.5], None), (106, [0.1] * 17, None), (None, [0.3] * 16, 9), (3, rows[3][1], 0), (3, [0.0] * 16, None),
             (107, [-0.0001] * 16, 5), (108, [1e200] * 16, 5), (109, [-1e30] * 16, 5)]
    assert same(found(spark, rows), plain(rows))
    assert same(found(spark, rows, entries=8), plain(rows, entries=8))


def test_copies_ties_and_one_label(spark):
    rows = [(i, [0.5, 0.5, 0.0, 0.0], 1) for i in range(300)] + [(i, [float(i % 2), 0.5, 0.25, 0.125], 1) for i in range(300, 340)]
    assert same(found(spark, rows, entries=4), plain(rows, entries=4))


def test_no_rows(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []


def test_walk_takes_whole_nodes():
    """Far apart groups are settled as nodes, and every point gets what comparing with all entries says."""
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(-3, 4, (200, 4)) + 1000 * k for k in range(5)])
    book = np.array([[1000 * k] * 4 for k in (3, 0, 1, 4, 2, 2)])
    order = vector_codes.tree_order(points, 8)
    tree = vector_codes.Tree(points[order], 8)
    entry, nodes = np.full(len(points), -1), []

    def whole(level, found_nodes, entries):
        for node, e in zip(found_nodes, entries):
            a, b = tree.levels[level][node : node + 2]
            entry[a:b] = e
            nodes.append(b - a)

    def leaf(first, last, left):
        entry[first:last] = left[vector_codes.nearest(tree.points[first:last], book[left], False)[0]]

    vector_codes.walk(tree, book, whole, leaf)
    assert np.array_equal(entry, vector_codes.nearest(tree.points, book, False)[0])
    assert sum(nodes) > 0.9 * len(points) and max(nodes) > 30
