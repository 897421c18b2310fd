"""Benchmark decontamination: windows of item size, embedded by random walks, matched by sampled positions, then verified.

A benchmark item of n words is found in a document where some window of n words is within edit distance `SHARE` * n
(rounded down) of it. Words are runs of letters and digits in lower case, compared by hash. With `free_end`, the default,
windows of any length count (those more than `SHARE` * n off cannot match), so a missing or
inserted word costs one edit; without it only windows of n words do, where it costs about two.

The CGK walk reads a word sequence and writes the current word at each of 3n steps; a random bit that depends on step and
word says whether it moves on. Two sequences that are a few edits apart fall into step again, so edit distance becomes
Hamming distance. Each of `REPEATS` independent walks samples `SAMPLES` written positions as a key; windows that share a
key with an item are candidates, and the exact edit distance decides. Only the first 1.5n steps are sampled: a walk goes on for
about 2n, so a key is made of words, not of what is written after the end. In trials a window within the allowed distance shares a key
in over 99 %, an unrelated one in under 6 %.

Only windows that can match are embedded: within edit distance k, a window shares at least n - 2 - 3k of its three-word runs
with the item (each edit spoils three at most), so windows with fewer runs of any item are left out without loss.

Items of fewer than `MIN_WORDS` words are searched for as they are, without edits.

Items are a query set held against all documents, in blocks of at most `BLOCK_BYTES` of text, one pass over the
documents per block; each pass sends only its block to the tasks, and its result is stored before the next block is read.

Cases: null or empty texts hold nothing; null items and those without a word are left out; repeated items are reported under each id; ids of documents may be null or repeated; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyvigil.llm.common import ID, KEY, id_back, identified, joined_bytes, mixed, span_hashes
from keyvigil.llm.repeats import text_blocks
from keyvigil.session import written

SHARE = 0.2
MIN_WORDS = 8
REPEATS, SAMPLES = 48, 3
RUN = 3
BLOCK_BYTES = 4_000_000
WINDOWS_AT_ONCE, PAIRS_AT_ONCE = 2_000, 5_000
PAD = np.uint64(0x5851F42D4C957F2D)
_BITS = 20

_PART = np.zeros(256, bool)
_PART[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

FOUND = f"{ID} long, {KEY} long, item_ids array<long>, starts array<int>, distances array<int>"


def normal_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of the first word of each text (one more at the end)."""
    data, starts = joined_bytes([x.decode("utf-8", "replace").lower().encode() for x in texts])
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    part = _PART[data]
    edges = np.flatnonzero(part[1:] != part[:-1]) + 1
    if part[0]:
        edges = np.concatenate((np.zeros(1, np.int64), edges))
    begin, end = edges[0::2], edges[1::2]
    return span_hashes(data.astype(np.uint64) + np.uint64(1), begin, end), np.searchsorted(begin, starts)


def edits_allowed(n: int, share: float = SHARE) -> int:
    return int(share * n + 1e-9)


def steps_sampled(n: np.ndarray) -> np.ndarray:
    return np.maximum(3 * n // 2, 1).astype(np.uint64)


def embedded_keys(words: np.ndarray, begin: np.ndarray, length: np.ndarray, n: np.ndarray, repeats: int, samples: int) -> np.ndarray:
    """Keys of windows (words[begin:begin + length]) of n words: a row per repeat, a column per window.

    Each repeat draws a salt per step and, for each n, the steps whose written word it samples.
    """
    seeds = np.arange(1, repeats + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    draws = [mixed(mixed(seeds + np.uint64(k + 1)) ^ n[None, :].astype(np.uint64)) for k in range(samples)]
    wanted = [(x % steps_sampled(n)[None, :]).astype(np.int64) for x in draws]
    at = np.repeat(begin[None, :], repeats, axis=0)
    end = (begin + length)[None, :]
    seen = [np.zeros(at.shape, np.uint64) for _ in range(samples)]
    for step in range(max((int(x.max()) for x in wanted if x.size), default=-1) + 1):
        current = np.where(at < end, words[np.minimum(at, len(words) - 1)], PAD)
        for value, place in zip(seen, wanted):
            np.copyto(value, current, where=place == step)
        salt = mixed(seeds ^ np.uint64((step + 1) << 32))
        at += (mixed(current ^ salt) & np.uint64(1)).astype(np.int64)
    key = mixed(seeds ^ n[None, :].astype(np.uint64))
    for value in seen:
        key = mixed(key * np.uint64(31) + value)
    return key


def edit_distances(
    words: np.ndarray, begin: np.ndarray, length: np.ndarray, item_words: np.ndarray, first: np.ndarray, n: np.ndarray, most: int,
    free_end: bool = False,
) -> np.ndarray:
    """Edit distance of each window to its item (item_words[first:first + n]), exact up to `most`, larger than it beyond.

    With `free_end`, the smallest distance of all beginnings of the window.

    Rows of the usual table, cut to a band, for all pairs at once; a running minimum takes the place of the step to the left.
    """
    pairs, far, width = len(begin), np.int32(most + 1), 2 * most + 1
    longest, deepest = int(length.max(initial=0)), int(n.max(initial=0))
    column = np.arange(width, dtype=np.int32)
    window = np.zeros((pairs, most + max(longest, deepest) + most + 1), np.uint64)
    inside = np.arange(longest)[None, :] < length[:, None]
    window[:, most : most + longest][inside] = words[(begin[:, None] + np.arange(longest)[None, :])[inside]]
    item = np.zeros((pairs, deepest), np.uint64)
    within = np.arange(deepest)[None, :] < n[:, None]
    item[within] = item_words[(first[:, None] + np.arange(deepest)[None, :])[within]]
    row = np.where(column >= most, column - most, far)[None, :].repeat(pairs, axis=0).astype(np.int32)
    result = np.full(pairs, far, np.int32)
    at = np.clip(length - n + most, 0, width - 1)
    reachable = length >= n - most if free_end else np.abs(length - n) <= most
    for i in range(1, deepest + 1):
        place = i + column - most  # how much of the window each column stands for
        new = row + (window[:, i - 1 : i - 1 + width] != item[:, i - 1 : i])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new[:, place == 0] = i
        new[(place < 0)[None, :] | (place[None, :] > length[:, None])] = far
        new = np.minimum.accumulate(new - column, axis=1) + column
        row = np.minimum(new, far).astype(np.int32)
        row[(place < 0)[None, :] | (place[None, :] > length[:, None])] = far
        done = (n == i) & reachable
        result[done] = row[done].min(axis=1) if free_end else row[done, at[done]]
    return result


class _Index:
    """One block of items: their three-word runs by number of words, and their keys in each repeat."""

    def __init__(self, items: list[tuple[int, str]], share: float, repeats: int, samples: int, free_end: bool):
        self.words, first = normal_words([text.encode() for _, text in items])
        count = np.diff(first)
        long_enough = count >= MIN_WORDS
        self.item_ids = [number for number, _ in items]
        numbers = np.arange(len(items))
        # Short items by their number of words: sorted hashes and places among the items.
        self.short = {}
        for n in range(1, MIN_WORDS):
            at = np.flatnonzero(count == n)
            if len(at):
                hashes = span_hashes(self.words, first[at], first[at] + n)
                order = np.argsort(hashes, kind="stable")
                self.short[n] = (hashes[order], numbers[at[order]])
        self.ids = numbers[long_enough]
        self.first, self.count = first[:-1][long_enough], count[long_enough]
        self.most = np.array([edits_allowed(int(n), share) for n in self.count], np.int64)
        self.repeats, self.samples, self.share, self.free_end = repeats, samples, share, free_end
        number = self.count - RUN + 1
        at = np.repeat(self.first - (np.cumsum(number) - number), number) + np.arange(number.sum())
        size = np.repeat(self.count, number)
        hashes = span_hashes(self.words, at, at + RUN) if len(at) else np.zeros(0, np.uint64)
        order = np.lexsort((size, hashes))
        hashes, size = hashes[order], size[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (size[1:] != size[:-1])
        self.runs, self.run_sizes = hashes[new], size[new]
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.runs >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        keys = embedded_keys(self.words, self.first, self.count, self.count, repeats, samples)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a run of an item starts, once for each number of words such items have."""
        places = np.arange(max(len(words) - RUN + 1, 0))
        hashes = span_hashes(words, places, places + RUN) if len(places) else np.zeros(0, np.uint64)
        near = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        low, high = (np.searchsorted(self.runs, hashes[near], side=side) for side in ("left", "right"))
        each = high - low
        entry = np.repeat(low - (np.cumsum(each) - each), each) + np.arange(each.sum())
        return np.repeat(near, each), self.run_sizes[entry]

    def windows(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, length and item size of every window with enough runs of items of its size.

        With a free end, windows are as long as the longest that can match.
        """
        hits, sizes = self.hits(words)
        found = []
        for n in np.unique(sizes):
            own = hits[sizes == n]
            most = edits_allowed(int(n), self.share)
            need = max(1, n - RUN + 1 - RUN * most)
            longest = n + most if self.free_end else n
            if len(own) < need:
                continue
            head, last = own[: len(own) - need + 1], own[need - 1 :]
            document = np.searchsorted(first, head, side="right") - 1
            good = (last - head <= longest - RUN) & (last < first[document + 1])
            head, last, document = head[good], last[good], document[good]
            low = np.maximum(last - (longest - RUN), first[document])
            each = np.maximum(head + 1 - low, 0)
            begin = np.unique(np.repeat(low - (np.cumsum(each) - each), each) + np.arange(each.sum()))
            length = np.minimum(first[np.searchsorted(first, begin, side="right")] - begin, longest)
            fits = length >= n - most
            found.append((begin[fits], length[fits], np.full(fits.sum(), n)))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def short_matches(self, words: np.ndarray, first: np.ndarray):
        """Places of items with place of the window and distance 0, for all windows that equal a short item."""
        for n, (hashes, ids) in self.short.items():
            places = np.arange(max(len(words) - n + 1, 0))
            ends = first[np.searchsorted(first, places, side="right")]
            places = places[places + n <= ends]
            if not len(places):
                continue
            own = span_hashes(words, places, places + n)
            low, high = (np.searchsorted(hashes, own, side=side) for side in ("left", "right"))
            each = high - low
            entry = np.repeat(low - (np.cumsum(each) - each), each) + np.arange(each.sum())
            yield ids[entry], np.repeat(places, each), np.zeros(len(entry), np.int64)

    def matches(self, words: np.ndarray, first: np.ndarray):
        """Places of items with place of the window and distance, for all windows of the block's documents that match."""
        yield from self.short_matches(words, first)
        begins, lengths, sizes = self.windows(words, first)
        for part in range(0, len(begins), WINDOWS_AT_ONCE):
            begin, length, size = (x[part : part + WINDOWS_AT_ONCE] for x in (begins, lengths, sizes))
            probes = embedded_keys(words, begin, np.minimum(length, size), size, self.repeats, self.samples)
            pairs = []
            for probe, keys, order in zip(probes, self.keys, self.order):
                low, high = (np.searchsorted(keys, probe, side=side) for side in ("left", "right"))
                each = high - low
                entry = np.repeat(low - (np.cumsum(each) - each), each) + np.arange(each.sum())
                pairs.append(np.repeat(np.arange(len(begin)), each) * len(self.ids) + order[entry])
            pairs = np.unique(np.concatenate(pairs))
            window, item = pairs // max(len(self.ids), 1), pairs % max(len(self.ids), 1)
            # Items of like size together, so that none is filled up to more than twice its words.
            scale = np.log2(self.count[item]).astype(int) if len(item) else item
            for level in np.unique(scale):
                for at in range(0, (scale == level).sum(), PAIRS_AT_ONCE):
                    w, i = (x[scale == level][at : at + PAIRS_AT_ONCE] for x in (window, item))
                    distance = edit_distances(
                        words, begin[w], length[w], self.words, self.first[i], self.count[i], int(self.most[i].max()),
                        self.free_end,
                    )
                    good = distance <= self.most[i]
                    yield self.ids[i[good]], begin[w[good]], distance[good]


def _search(items: list[tuple[int, str]], share: float, repeats: int, samples: int, free_end: bool):
    index = _Index(items, share, repeats, samples, free_end)  # built once; its size is bounded by the block

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            words, first = normal_words(texts)
            found: dict[int, dict[int, tuple[int, int]]] = {}
            for item, begin, distance in index.matches(words, first):
                document = np.searchsorted(first, begin, side="right") - 1
                for d, i, b, e in zip(document.tolist(), item.tolist(), begin.tolist(), distance.tolist()):
                    best = found.setdefault(d, {})
                    best[i] = min(best.get(i, (math.inf, 0)), (e, b - int(first[d])))
            rows = sorted(found)
            lists = [sorted((index.item_ids[i], b, e) for i, (e, b) in found[d].items()) for d in rows]
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    taken.column(0), taken.column(1), pa.array([[x[0] for x in y] for y in lists], pa.list_(pa.int64())),
                    pa.array([[x[1] for x in y] for y in lists], pa.list_(pa.int32())),
                    pa.array([[x[2] for x in y] for y in lists], pa.list_(pa.int32())),
                ],
                names=[ID, KEY, "item_ids", "starts", "distances"],
            )

    return search


def matches(
    docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE,
    repeats: int = REPEATS, samples: int = SAMPLES, free_end: bool = True,
) -> DataFrame:
    """Per document that holds items: id, key, item_ids with the start (in words) and distance of the best window of each."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("long"), F.lit(-1)).alias("item"), F.col(item_text_col).cast("string").alias("item_text")
    ).where("item_text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    parts = []
    for block in range(blocks):
        chosen = items.where(F.pmod(F.xxhash64("item", "item_text"), F.lit(blocks)) == block).orderBy("item", "item_text").collect()
        part = docs.mapInArrow(_search([tuple(row) for row in chosen], share, repeats, samples, free_end), FOUND)
        parts.append(written(part, "leaks") if blocks > 1 else part)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    lists = {c: F.flatten(F.collect_list(c)).alias(c) for c in ("item_ids", "starts", "distances")}
    # Repeated rows give equal lists: one is enough. Blocks have different items.
    return found.distinct().groupBy(ID, KEY).agg(*lists.values())


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Per row: doc_id, contaminated, n_items, item_ids and distances (in order of item)."""
    known = identified(docs, id_col, text_col)
    found = matches(known, benchmark, **options)
    none = F.array()
    return known.select(ID, KEY).join(found, [ID, KEY], "left").select(
        id_back().alias("doc_id"),
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none.cast("array<long>")).alias("item_ids"),
        F.coalesce("distances", none.cast("array<int>")).alias("distances"),
    )
