from __future__ import annotations

import random
import re
import zlib

import brute
import edges
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from keyvigil.llm import catalog, periodic_runs


def plain(words):
    """Every period at every place, the smallest one of equal stretches."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(12, 2 * q):
                found.setdefault((start, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    keep = [True] * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = [False] * (length - period)
    return " ".join(w for w, k in zip(words, keep) if k)


def of_texts(texts):
    """One block, without Spark."""
    ids = pa.array(range(len(texts)), pa.int64())
    batch = periodic_runs._read(pa.RecordBatch.from_arrays([ids, ids], names=["a", "b"]), [t.encode() for t in texts])
    return [([(r["start"], r["length"], r["period"]) for r in runs], text) for runs, text in zip(*(batch.column(k).to_pylist() for k in (3, 4)))]


def check(texts):
    for text, (runs, left) in zip(texts, of_texts(texts)):
        words = brute.WORD.findall(text)
        assert runs == plain(words), text
        assert left == collapsed(words, runs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), st.integers(1, 8)), max_size=5), max_size=6))
def test_texts_of_repeated_pieces(made):
    check([" ".join(" ".join(piece * times) for piece, times in text) for text in made])


def test_known_strings():
    fibonacci = ["a", "b"]
    while len(fibonacci[-1]) < 200:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    morse = "a"
    while len(morse) < 200:
        morse += morse.translate(str.maketrans("ab", "ba"))
    check([" ".join(x) for x in ("a" * 11, "a" * 12, "ab" * 6, "abc" * 4 + "ab", "a" * 300, fibonacci[-1], morse, "abaab" * 9, "")])


def test_a_block_of_many_texts_and_one_very_long_text():
    rng = random.Random(5)
    check([" ".join(rng.choice("ab") for _ in range(rng.randrange(80))) for _ in range(400)])
    (runs, left), = of_texts([" ".join("x y z".split() * 100_000)])
    assert runs == [(0, 300_000, 3)] and left == "x y z"


def planted(doc, text):
    words = brute.WORD.findall(text or "")
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and words:
        a = (h // 10) % len(words)
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc, text):
    words = planted(doc, text)
    runs = plain(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, brute.sha(listed), brute.sha(collapsed(words, runs)))


def answers(spark, monkeypatch, frame):
    monkeypatch.setattr(catalog, "_documents", lambda spark, folder: frame)
    return [tuple(r) for r in catalog.op12_periodic_runs(spark, "").collect()]


def test_query_on_odd_rows(spark, monkeypatch):
    rows = [(i, t) for i, t in edges.texts() if not re.search("alpha0? ", (t or "")[:0])]
    rows += [(i + 1000, f"{i} some words of a text that may end in a period or two {edges.sentence(random.Random(i), i % 30)}") for i in range(120)]
    rows += [(None, "a b " * 20), (None, None), (7, "q " * 30), (7, "q " * 30)]
    found = answers(spark, monkeypatch, edges.frame(spark, rows))
    assert sorted(map(repr, found)) == sorted(repr(expected(*r)) for r in rows)
    assert answers(spark, monkeypatch, edges.frame(spark, [], 1)) == []


def test_query_on_given_documents(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 20_000]
    found = {r[0]: r for r in answers(spark, monkeypatch, docs)}
    assert len(rows) > 150 and all(found[doc] == expected(doc, text) for doc, text in rows)
