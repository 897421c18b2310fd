from __future__ import annotations

import random

import edges
import numpy as np

from keyvigil.llm import decontamination


def normal(text):
    words, current = [], ""
    for c in (text or "").lower():
        if c.isascii() and not c.isalnum():
            words.append(current)
            current = ""
        else:
            current += c
    return [w for w in [*words, current] if w]


def nearest(words, own):
    """Smallest distance of the item to any run of words of the document, wherever it begins and ends."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(own, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def plain(rows, items):
    """Items with a run of words within the allowed distance, by trying all; those of under 8 words as they are."""
    found = {}
    for doc, text in rows:
        words = normal(text)
        hits = []
        for item, item_text in items:
            own = normal(item_text)
            n, most = len(own), int(0.2 * len(own) + 1e-9)
            if 0 < n < 8 and any(words[s : s + n] == own for s in range(len(words) - n + 1)):
                hits.append(item)
            if n >= 8 and len(set(own) & set(words)) > 0.3 * len(set(own)) and nearest(words, own) <= most:
                hits.append(item)
        found[doc] = sorted(hits)
    return found


def edit(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = f"sub{rng.randrange(999)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"ins{rng.randrange(999)}")
    return words


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string, doc_id long, start int") if items and len(items[0]) > 2 else (
        spark.createDataFrame(items, "item_id long, text string"))


def found(spark, rows, items):
    result = decontamination.decontaminated(edges.frame(spark, rows), benchmark(spark, items)).collect()
    assert all(r["contaminated"] == (r["n_items"] > 0) == bool(r["item_ids"]) for r in result)
    return {r["doc_id"]: r["item_ids"] for r in result}


def test_planted_passages_with_edits(spark):
    rng = random.Random(6)
    items = [(i, edges.sentence(rng, rng.randrange(8, 60))) for i in range(30)] + [(90, "too short an item"), (91, None), (92, "")]
    rows = []
    for i in range(150):
        words = normal(items[rng.randrange(30)][1])
        hidden = edit(rng, words, rng.randrange(int(0.2 * len(words)) + 3))
        text = f"{edges.sentence(rng, rng.randrange(40))} {' '.join(hidden)}, {edges.sentence(rng, rng.randrange(40))}"
        rows.append((i, text.upper() if i % 3 == 0 else text.replace(" ", ",\n", 3)))
    rows += [(505, f"{edges.sentence(rng, 9)} Too short; an ITEM {edges.sentence(rng, 9)}"), (506, "too short an itemx")]
    rows += [(500, None), (501, ""), (502, edges.sentence(rng, 3000)), (503, items[0][1]), (504, f"{items[1][1]} {items[2][1]}")]
    expected = plain(rows, items)
    result = found(spark, rows, items)
    wanted = sum(map(len, expected.values()))
    missed = sum(len(set(expected[d]) - set(result[d])) for d in expected)
    assert all(set(result[d]) <= set(expected[d]) for d in expected)
    assert wanted > 100 and missed <= 0.01 * wanted


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    queries = [(r["item_id"], r["text"]) for r in items.select("item_id", "text").collect()]
    result = {r["doc_id"]: r["item_ids"] for r in decontamination.decontaminated(docs, items).collect()}
    exact = {d: [i for i, q in queries if q in (t or "")] for d, t in rows}
    assert all(set(exact[d]) <= set(result[d]) for d in exact)
    small = [(d, t) for d, t in rows if len(t) < 3000][:60]
    assert {d: result[d] for d, _ in small} == plain(small, queries)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i, edges.sentence(rng, 20)) for i in range(12)]
    rows = [(i, f"{edges.sentence(rng, 5)} {items[i][1]} {items[(i + 1) % 12][1]}") for i in range(12)]
    whole = found(spark, rows, items)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 600)
    assert {d: sorted(x) for d, x in found(spark, rows, items).items()} == whole
    assert whole == {i: sorted((i, (i + 1) % 12)) for i in range(12)}


def test_no_rows_no_items_null_and_repeated_ids(spark):
    text = edges.sentence(random.Random(1), 30)
    assert found(spark, [(1, text)], [(1, None)]) == {1: []}
    assert decontamination.decontaminated(edges.frame(spark, [], 1), benchmark(spark, [(1, text)])).count() == 0
    result = decontamination.decontaminated(
        edges.frame(spark, [(None, text), (3, text), (3, text), (3, "no")]), benchmark(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted((str(r["doc_id"]), r["item_ids"]) for r in result) == [("3", []), ("3", [1, 1, 2]), ("3", [1, 1, 2]), ("None", [1, 1, 2])]


def _meet(pairs):
    """How many of the pairs of word sequences share a key."""
    met = 0
    for words, other in pairs:
        n = len(words)
        other = [x if isinstance(x, int) else hash(x) % 2**62 for x in other][:n]
        keys = decontamination.embedded_keys(
            np.array(words + other, np.uint64), np.array([0, n]), np.array([n, len(other)]), np.array([n, n]),
            decontamination.REPEATS, decontamination.SAMPLES)
        met += bool((keys[:, 0] == keys[:, 1]).any())
    return met


def test_recall_of_the_sampled_walks():
    """At the largest allowed distance, keys meet for at least 99 of 100 windows."""
    rng = random.Random(11)
    pairs = []
    for _ in range(300):
        words = [rng.randrange(2**62) for _ in range(rng.randrange(10, 60))]
        pairs.append((words, edit(rng, words, int(0.2 * len(words)))))
    assert _meet(pairs) >= 297


def test_unrelated_windows_seldom_meet():
    rng = random.Random(13)
    draw = lambda n: [rng.randrange(2**62) for _ in range(n)]
    assert _meet([(draw(n), draw(n)) for n in (*range(8, 60), 80, 120) for _ in range(10)]) <= 5
    # Words as frequent as in prose: the k-th one of 3000 with a share of about 1 / k.
    often = [1.0 / k for k in range(1, 3001)]
    prose = lambda n: rng.choices(range(3000), often, k=n)
    pairs = [(prose(n), prose(n)) for n in range(15, 60) for _ in range(6)]
    assert _meet(pairs) <= 0.05 * len(pairs)


def test_missing_and_inserted_words_cost_one_edit_each(spark):
    """With a free end, against all windows of all lengths; items stand in the middle of documents."""
    rng = random.Random(12)
    items = [(i, edges.sentence(rng, n)) for i, n in enumerate((15, 15, 20, 8, 9, 17, 21, 33, 44, 59))]
    rows, k = [], 0
    for _, text in items:
        own = normal(text)
        most = int(0.2 * len(own) + 1e-9)
        for edits in range(most + 2):
            for kind in ("less", "more", "mixed"):
                hidden = list(own)
                for at in sorted(rng.sample(range(2, len(own) - 2), edits), reverse=True):
                    if kind == "less":
                        del hidden[at]
                    elif kind == "more":
                        hidden.insert(at, f"new{rng.randrange(999)}")
                if kind == "mixed":
                    hidden = edit(rng, hidden, edits)
                rows.append((k, f"{edges.sentence(rng, 30)} {' '.join(hidden)} {edges.sentence(rng, 30)}"))
                k += 1
    expected = {d: [i for i, q in items if nearest(normal(t), normal(q)) <= int(0.2 * len(normal(q)) + 1e-9)] for d, t in rows}
    result = decontamination.decontaminated(edges.frame(spark, rows), benchmark(spark, items)).collect()
    wanted = sum(map(len, expected.values()))
    assert all(set(r["item_ids"]) <= set(expected[r["doc_id"]]) for r in result)
    assert wanted > 100 and sum(len(expected[r["doc_id"]]) - r["n_items"] for r in result) <= 0.01 * wanted
    for r in result:
        words = normal(rows[r["doc_id"]][1])
        assert r["distances"] == [nearest(words, normal(items[i][1])) for i in r["item_ids"]]
    assert {r["doc_id"] for r in result if r["contaminated"]} > set(range(9))  # 15 words, up to 2 left out or put in
