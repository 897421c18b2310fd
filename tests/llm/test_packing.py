from __future__ import annotations

import functools
import itertools
import random
import zlib
from collections import Counter, defaultdict

import edges
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from keyvigil.llm import packing


@functools.cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, found, capacity):
    """Every piece once, sequences gapless from 0 and within the capacity. Returns the number of sequences."""
    ids = {doc: plain_ids(text) for doc, text in rows}
    expected = Counter()
    for doc, all_ids in ids.items():
        for piece, start in enumerate(range(0, len(all_ids), capacity)):
            part = np.array(all_ids[start : start + capacity], "<u4")
            expected[doc, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_odd_cases_and_given_documents(spark):
    given = [(r[0] + 1000, r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = edges.texts() + [(500, "<|endoftext|> it's 12ab ÀÉ<|startoftext|>x"), (501, "é Å ﬁ İ")] + given
    found = packing.pack_documents(edges.frame(spark, rows)).collect()
    used = check(rows, found, packing.CAPACITY)
    total = sum(r["length"] for r in found)
    assert used <= -(-total // packing.CAPACITY) * 1.02 + 1
    by_piece = {(r["doc_id"], r["piece"]): bytes(r["ids"]) for r in found}
    assert by_piece[3, 0] == np.array(plain_ids("one"), "<u4").tobytes()


ODD = [
    "the '05 class", "hello world again", "10€ or 20 €", "0° and 30°C", "pages 10–20", "café0", "“0”", "0", "'0'", "0'0 0",
    "it's 1990's", "x0é0y", "０ １２", "٠١٢", "a\u00000b", "don't 0 can't", "", " ",
]


def test_ids_of_mixed_words_in_one_batch():
    """All texts share one call, so that a word read wrongly would spoil those after it."""
    rng = random.Random(11)
    signs = "abcXYZ0019'’“”€°–éßçñİſǅ中文0٠０ \t\n.,!?#-_<|>½²①\u200b\u0301\x7f\x01"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["".join(chr(c) for c in (rng.randrange(1, 0x3000) for _ in range(20)) if not 0xD800 <= c < 0xE000) for _ in range(1000)]
    words = packing._Words(public_tokenizers.path("word_bpe_49k.json"))
    ids, bounds = packing._tokenised([t.encode() for t in texts], words, 1)
    for k, own in enumerate(tokenizer().encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*own.ids, 1], texts[k]


def test_small_capacity_cuts_pieces(spark):
    rows = [(i, edges.sentence(random.Random(i), i)) for i in range(40)]
    check(rows, packing.pack_documents(edges.frame(spark, rows), capacity=32).collect(), 32)


def test_no_rows_and_null_ids(spark):
    assert packing.pack_documents(edges.frame(spark, [], 1)).count() == 0
    found = packing.pack_documents(edges.frame(spark, [(None, None), (None, None), (3, "a"), (3, "a")])).collect()
    assert len(found) == 4 and len({(r["sequence_id"], r["offset"]) for r in found}) == 4


def least_bins(sizes, capacity):
    """Exact minimum by trying all ways."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity:
                bins[i] += sizes[k]
                place(k + 1, bins)
                bins[i] -= sizes[k]
        place(k + 1, [*bins, sizes[k]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(3)
    fixed_some = 0
    for _ in range(300):
        capacity = rng.randrange(12, 40)
        low = rng.choice((1, capacity // 5, capacity // 3))
        sizes = [rng.randrange(max(1, low), capacity + 1) for _ in range(rng.randrange(1, 9))]
        fixed, rest = packing.reduction(Counter(sizes), capacity)
        left = list(itertools.chain.from_iterable([s] * n for s, n in rest.items()))
        back = Counter(rest)
        for content, times in fixed:
            assert sum(content) <= capacity
            for size in content:
                back[size] += times
        assert back == Counter(sizes)
        number = sum(times for _, times in fixed)
        fixed_some += number > 0
        assert number + least_bins(left, capacity) == least_bins(sizes, capacity)
    assert fixed_some > 250


def test_best_fit_packs_everything_close_to_the_bound():
    rng = random.Random(4)
    counts = Counter(min(4096, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(20000))
    groups = packing.best_fit(counts, 4096)
    back = Counter()
    for content, number in groups:
        assert sum(s * k for s, k in content) <= 4096
        for size, times in content:
            back[size] += times * number
    assert back == counts
    total = sum(s * n for s, n in counts.items())
    assert sum(n for _, n in groups) <= -(-total // 4096) + 3


def test_single_words_skip_what_leaves_them_whole(monkeypatch):
    """Lower-case and Latin words and signs go straight to the merges, with the tokenizer's ids; all others pass all of it."""
    path = public_tokenizers.path("word_bpe_49k.json")
    words = packing._words(path)
    assert packing._words(path) is words and words.direct
    letters = "".join(map(chr, [*range(33, 127), *range(0xC0, 0x250)]))
    texts = [a + b for a in ("", "x", "é", "<") for b in letters] + ["Ünîcödé ŒUVRE ſtraße ǅ", "don't İx é 中文 ²٣ ﬁ ­"]
    ids, bounds = packing._tokenised([t.encode() for t in texts], words, 1)
    encoded = words.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [[*e.ids, 1] for e in encoded]
    fresh, passed = packing._Words(path), []
    monkeypatch.setattr(fresh, "whole", lambda text: passed.append(text) or words.whole(text))
    packing._tokenised("plain words, größe (und) Œuvre; 中文 isn't".encode().split(b"\n"), fresh, 1)
    assert sorted(passed) == sorted(["isn't", "中文"])
    fresh.direct, fresh.known = False, {}
    assert fresh.ids([b"plain", "größe".encode()]) == words.ids([b"plain", "größe".encode()]) and passed[2:] == ["plain", "größe"]
