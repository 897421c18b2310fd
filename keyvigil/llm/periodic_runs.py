"""Periodic runs of words in a text, from maximal pairs of its suffixes.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least max(12, 2q)
words, which no neighbouring word extends with that period. The suffixes of all texts of a block are sorted by doubling,
and their common prefixes give the tree of LCP intervals. It is gone through from the leaves up; each node holds the places of its suffixes by position, every place with the
class of its left word. Where two nodes meet at a common prefix of n words, places of the two whose left words differ form
maximal pairs: n words from both are equal, and neither side can be extended. A pair is a run exactly if its distance is at
most n and distance + n is at least 12: it needs no further extension. Among equal stretches the smallest distance is the period.

The two places of a run by its smallest period are neighbours among the places of their node (the repeated piece is not a
power, so it cannot start anywhere between). So only neighbours across the two lists are looked at, the shorter list against
the longer one: n log n of them in all, also in a text that is one word over and over.

Common prefixes below 6 words meet no constraint. So suffixes are sorted only where their first six words come again in
the text, and groups of them whose places are all farther apart than their longest common prefix are left out.

Cases: null and empty texts have no words and no runs; ids may be null or repeated, each row is read alone; a text is read
whole at any length, one text or a block of short ones at a time; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyvigil.llm.common import ID, KEY, TEXT, WHITE_RUN, id_back, identified, joined_bytes, mixed, span_hashes, word_bounds
from keyvigil.llm.repeats import text_blocks

LEAST, GRAM = 12, 6
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _word_ids(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal words, equal numbers."""
    sizes = ends - begins
    offsets = np.zeros(len(begins) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    inside = np.repeat(begins - offsets[:-1], sizes) + np.arange(offsets[-1])
    packed = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())])
    return packed.dictionary_encode().indices.to_numpy().astype(np.int64)


def _repeated_grams(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places whose first GRAM words come again in the same text, by their hashes: a few others do no harm."""
    places = np.arange(len(words) - GRAM + 1)
    values = mixed(words.astype(np.uint64))
    keys = span_hashes(values, places, places + GRAM) ^ mixed(text[places].astype(np.uint64) + np.uint64(1 << 40))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(order), bool)
    again[1:] = same
    again[:-1] |= same
    return order[again]


def _sorted_suffixes(words: np.ndarray, text: np.ndarray, found: np.ndarray):
    """The places in the order of their suffixes, where each group of equal first GRAM words begins, the ranks by the first 6, 12, 24
    ... words, and the number of each place in the ranks (-1: none).

    Doubling asks for ranks at `found` and GRAM words further on only; elsewhere the six words don't come again.
    """
    n = len(words)
    number = np.full(n + 1, -1, np.int64)
    number[found] = 0
    number[np.minimum(found + GRAM, n)] = 0
    number[n] = -1
    ranked = np.flatnonzero(number == 0)
    number[ranked] = np.arange(len(ranked))
    padded = np.append(words, np.full(GRAM, -1))
    columns = [text[ranked], *(padded[ranked + k] for k in range(GRAM))]
    by = np.lexsort(columns[::-1])
    new = np.ones(len(by), bool)
    new[1:] = np.any([c[by][1:] != c[by][:-1] for c in columns], axis=0)
    order = ranked[by]
    rank = np.empty(len(by), np.int64)
    rank[by] = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    levels = [(GRAM, rank)]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(by)))
    several = np.repeat(sizes > 1, sizes)
    active = np.flatnonzero(several)
    length = GRAM
    while len(active):
        places = order[active]
        first, second = rank[number[places]], rank[number[np.minimum(places + length, n)]]
        by = np.lexsort((second, first))
        places, first, second = places[by], first[by], second[by]
        order[active] = places
        new = np.ones(len(active), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(active)))
        rank = rank.copy()
        rank[number[places]] = np.repeat(active[starts], sizes)
        length *= 2
        levels.append((length, rank))
        active = active[np.repeat(sizes > 1, sizes)]
    order = order[several]
    group = levels[0][1][number[order]]
    return order, np.flatnonzero(np.diff(group, prepend=-1)), levels, number


def _common(a: np.ndarray, b: np.ndarray, levels, number, words: np.ndarray) -> np.ndarray:
    """How many words two suffixes have in common."""
    n = len(words)
    done = np.zeros(len(a), np.int64)
    for length, rank in reversed(levels):
        own, other = number[np.minimum(a + done, n)], number[np.minimum(b + done, n)]
        done += np.where((own >= 0) & (other >= 0) & (rank[own] == rank[other]), length, 0)
    for _ in range(GRAM - 1):
        # Every text ends in a word of its own, so the comparison stops there. A place that stopped gives the same answer again.
        done += words[a + done] == words[b + done]
    return done


def _pairs_of_tree(places: list[int], common: list[int], left: list[int], least: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of the neighbouring maximal pairs of a group of sorted suffixes that meet the constraints.

    common[k]: words that suffix k shares with the one before it. The nodes are intervals of the sorted suffixes; each
    keeps its places by position under its first and last index.
    """
    found = []
    lists: dict[int, list[int]] = {}  # by first index of the interval
    last: dict[int, int] = {}
    first: dict[int, int] = {}
    for k in sorted(range(1, len(places)), key=common.__getitem__, reverse=True):
        n = common[k]
        a = first.pop(k - 1, k - 1)
        b = last.pop(k, k)
        one = lists.pop(a, None) or [places[a]]
        two = lists.pop(k, None) or [places[k]]
        small, large = (one, two) if len(one) <= len(two) else (two, one)
        for p in small:
            at = bisect_left(large, p)
            if at:
                q = large[at - 1]
                if p - q <= n and p - q + n >= least and left[p] != left[q]:
                    found.append((q, p + n, p - q))
            if at < len(large):
                q = large[at]
                if q - p <= n and q - p + n >= least and left[p] != left[q]:
                    found.append((p, q + n, q - p))
        if 8 * len(small) > len(large):
            large.extend(small)
            large.sort()
        else:
            for p in small:
                insort(large, p)
        lists[a] = large
        last[a], first[b] = b, a
    return found


def _stretches(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """All runs (start, end, period), sorted by start, then period. Every text ends in a word of its own."""
    nothing = np.zeros((0, 3), np.int64)
    if len(words) < LEAST:
        return nothing
    found = _repeated_grams(words, text)
    order, heads, levels, number = _sorted_suffixes(words, text, found)
    if not len(order):
        return nothing
    sizes = np.diff(np.append(heads, len(order)))
    group = np.repeat(np.arange(len(heads)), sizes)
    common = np.zeros(len(order), np.int64)
    inner = np.flatnonzero(group[1:] == group[:-1]) + 1
    common[inner] = _common(order[inner - 1], order[inner], levels, number, words)
    # Groups whose places are all farther apart than their longest common prefix hold no run.
    by_place = order[np.lexsort((order, group))]
    gap = np.full(len(order), len(words) + 1)
    gap[inner] = by_place[inner] - by_place[inner - 1]
    near = np.minimum.reduceat(gap, heads) <= np.maximum.reduceat(common, heads)
    left = np.append(-1, words[:-1])  # before a text's first word: the end of the text before it, unlike all others
    # Most groups are two places: one pair each.
    k = heads[near & (sizes == 2)]
    a, b, n = np.minimum(order[k], order[k + 1]), np.maximum(order[k], order[k + 1]), common[k + 1]
    good = (b - a <= n) & (b - a + n >= LEAST) & (left[a] != left[b])
    pairs = [np.column_stack((a, b + n, b - a))[good]]
    many = np.flatnonzero(near & (sizes > 2))
    if len(many):
        lefts = left.tolist()
        for g in many.tolist():
            part = slice(heads[g], heads[g] + sizes[g])
            own = _pairs_of_tree(order[part].tolist(), common[part].tolist(), lefts, LEAST)
            if own:
                pairs.append(np.array(own, np.int64))
    all_pairs = np.concatenate(pairs)
    all_pairs = all_pairs[np.lexsort((all_pairs[:, 2], all_pairs[:, 1], all_pairs[:, 0]))]
    new = np.ones(len(all_pairs), bool)
    new[1:] = (all_pairs[1:, :2] != all_pairs[:-1, :2]).any(1)
    runs = all_pairs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))] if len(runs) else nothing


def _read(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
    data, starts = joined_bytes(texts)
    begins, ends = word_bounds(data)
    before = np.searchsorted(begins, starts)  # number of the first word of each text, and of all words
    counts = np.diff(before)
    # A word of its own, a negative number, is put after each text.
    words = np.insert(_word_ids(data, begins, ends), before[1:], -2 - np.arange(len(texts)))
    first = before + np.arange(len(texts) + 1)
    text = np.repeat(np.arange(len(texts)), counts + 1)
    runs = _stretches(words, text)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    kept = np.cumsum(gone)[:-1] == 0
    of_text = np.searchsorted(runs[:, 0], first)
    collapsed = []
    for k, raw in enumerate(texts):
        own = raw.split()
        if of_text[k + 1] > of_text[k]:
            own = compress(own, kept[first[k] : first[k + 1] - 1].tolist())
        collapsed.append(b" ".join(own).decode())
    home = text[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    each = pa.StructArray.from_arrays(
        [pa.array(runs[:, 0] - first[home]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(_RUN)
    )
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(counts), pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), each),
         pa.array(collapsed, pa.string())],
        names=[ID, KEY, "n_words", "runs", "collapsed_text"],
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_blocks(batches):
        yield _read(batch, texts)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, `runs` (start, length, period; by start, then period) and `collapsed_text`: the words
    outside all runs or among the first `period` words of those that hold them, joined by one space."""
    schema = f"{ID} long, {KEY} long, n_words long, runs {RUNS}, collapsed_text string"
    found = identified(docs, id_col, text_col).select(ID, KEY, TEXT).mapInArrow(_blocks, schema)
    return found.select(id_back().alias("doc_id"), "n_words", "runs", "collapsed_text")


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where one text in ten ends in a periodic tail, chosen and shaped by a checksum of its id (null ids: unchanged).

    With h = crc32(decimal id), g = h div 10 and n words: if h % 10 = 0 and n > 0, each word i >= a becomes word
    a + (i-a) % p, where a = g % n and p = 1 + (n-a) div (3 + g%8).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    words = F.regexp_extract_all("text", F.lit(f"[^{WHITE_RUN[1:-2]}]+"), F.lit(0))
    shaped = rows.withColumn("_h", h).withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    shaped = shaped.withColumn("_a", F.when(n > 0, g % n).cast("int"))
    shaped = shaped.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))
    rest = n - F.col("_a")
    piece = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    whole = F.flatten(F.array_repeat(piece, F.floor(rest / F.col("_p")).cast("int")))
    tail = F.slice("_words", F.col("_a") + 1, (rest % F.col("_p")).cast("int"))
    periodic = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), whole, tail), " ")
    return shaped.select("doc_id", F.when(F.col("_p").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))
