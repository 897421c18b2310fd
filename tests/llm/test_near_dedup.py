from __future__ import annotations

import random
from collections import Counter

import brute
import edges
import numpy as np
from pyspark.sql import functions as F

from keyvigil.llm import near_dedup
from keyvigil.llm.components import components


def shingles(text):
    words = brute.WORD.findall(text or "")
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    """The larger of probability and plain Jaccard similarity, from the definition."""
    if not a or not b:
        return 0.0
    plain = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    keys = list(a.keys() | b.keys())
    x = np.array([a[k] for k in keys], float)
    y = np.array([b[k] for k in keys], float)
    total = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in np.flatnonzero((x > 0) & (y > 0)))
    return max(plain, total)


def plain_classes(rows):
    """Smallest id of each document's component among all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and sets[i].keys() & sets[j].keys() and similarity(sets[i], sets[j]) >= 0.8 - 1e-12:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}


def classes(docs):
    return {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}


def edited(rng, text, share):
    words = text.split()
    for i in rng.sample(range(len(words)), int(share * len(words))):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_odd_cases(spark):
    rows = edges.texts()
    assert classes(edges.frame(spark, rows)) == plain_classes(rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    assert classes(docs.repartition(3)) == plain_classes(rows)


def test_a_group_whose_members_are_not_all_alike(spark):
    """Copies of one text, each changed in its own places, and chains of changes."""
    rng = random.Random(8)
    base = edges.sentence(rng, 300)
    rows = [(0, base)] + [(i, edited(rng, base, 0.02)) for i in range(1, 60)]
    chain = edges.sentence(rng, 200)
    for i in range(100, 112):
        rows.append((i, chain))
        chain = edited(rng, chain, 0.015)
    assert classes(edges.frame(spark, rows)) == plain_classes(rows)


def test_null_and_repeated_rows(spark):
    found = near_dedup.near_duplicates(edges.frame(spark, [(None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (9, None)])).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["stays"]) for r in found) == [
        ("4", "None", False), ("4", "None", False), ("9", "9", True), ("None", "None", True)]
    assert near_dedup.near_duplicates(edges.frame(spark, [], 1)).count() == 0


def test_registers_agree_like_the_similarity():
    rng = np.random.default_rng(1)
    universe = rng.integers(0, 2**63, 400, dtype=np.uint64)
    x = rng.integers(1, 6, 300)
    y = np.where(rng.random(300) < 0.7, x, rng.integers(1, 6, 300))
    a, b = np.arange(300), np.arange(40, 340)
    hashes = np.concatenate((universe[a], universe[b]))
    document = np.repeat([0, 1], 300)
    registers = near_dedup.signatures(hashes, document, np.concatenate((x, y)), 2, 20000)
    order_a, order_b = np.argsort(universe[a]), np.argsort(universe[b])
    exact, _ = near_dedup.similarities(universe[a][order_a], x[order_a], universe[b][order_b], y[order_b])
    left = Counter(dict(zip(a.tolist(), x.tolist())))
    right = Counter(dict(zip(b.tolist(), y.tolist())))
    keys = sorted(left.keys() | right.keys())
    u, v = np.array([left[k] for k in keys], float), np.array([right[k] for k in keys], float)
    plain = sum(1 / np.maximum(u / u[i], v / v[i]).sum() for i in np.flatnonzero((u > 0) & (v > 0)))
    assert abs(exact - plain) < 1e-12
    assert abs((registers[0] == registers[1]).mean() - exact) < 0.015


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [
        (rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: find(i) for i in list(root) if find(i) != i}
    assert components(spark.createDataFrame([], "a long, b long")).agg(F.count("*")).first()[0] == 0


def test_copies_with_a_repeated_line(spark):
    """Pairs that only the plain similarity links: one copy says a line over and over."""
    rng = random.Random(13)
    rows = []
    for i in range(0, 40, 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(304)]
        line = " ".join(f"r{rng.randrange(10**6)}" for _ in range(8))
        rows += [(i, " ".join(words)), (i + 1, " ".join(words) + f" {line}" * 60)]
    expected = plain_classes(rows)
    assert expected == {i: i - i % 2 for i in range(40)}
    assert classes(edges.frame(spark, rows)) == expected


def test_near_copies_with_null_or_repeated_ids_leave_one(spark):
    rng = random.Random(31)
    words = edges.sentence(rng, 120).split()
    near = lambda k: " ".join([*words[:k], f"new{k}", *words[k + 1 :]])
    rows = [(None, near(10)), (None, near(50)), (None, near(90)), (7, edges.sentence(rng, 60))]
    found = near_dedup.near_duplicates(edges.frame(spark, rows)).collect()
    assert [r["stays"] for r in found if r["doc_id"] is None].count(True) == 1
    assert [r["stays"] for r in found if r["doc_id"] == 7] == [True]
    rows = [(5, near(10)), (5, near(50)), (5, near(90)), (9, near(30))]
    found = near_dedup.near_duplicates(edges.frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["stays"]) for r in found) == [(5, False), (5, False), (5, True), (9, False)]


def test_chunks_are_compared_exactly(monkeypatch):
    """Common shingles by matrix products (also over several blocks of columns) and one set against many, pair by pair."""
    monkeypatch.setattr(near_dedup, "COLUMNS", 7)
    rng = np.random.default_rng(5)
    sides = []
    for size in (9, 13):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype("<u4") for _ in range(size)]
        weights = [rng.integers(1, 4, len(s)) if k % 2 else np.ones(len(s), np.int64) for k, s in enumerate(sets)]
        sides.append((sets, weights, np.concatenate(sets), np.repeat(np.arange(size), [len(s) for s in sets])))
    (ones, one_weights, left, left_row), (others, other_weights, right, right_row) = sides
    common = near_dedup._common(left, left_row, len(ones), right, right_row, len(others))
    assert common.tolist() == [[len(set(a) & set(b)) for b in others] for a in ones]
    assert near_dedup._common(left, left_row, len(ones), right + 100, right_row, len(others)).sum() == 0
    for a, x in zip(ones, one_weights):
        found = near_dedup.similarities_to(a, x, right, np.concatenate(other_weights), right_row, len(others))
        expected = [near_dedup.similarities(a, x, b, y)[0] for b, y in zip(others, other_weights)]
        assert np.allclose(found, expected, rtol=0, atol=1e-12)
