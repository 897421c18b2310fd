"""Suffix-array dedup on bytes: every `width`-byte string that starts anywhere else too is removed from each document.

Routing. Each window of `width` bytes picks its smallest `GRAM`-byte hash as anchor, so equal windows pick equal anchors.
Anchors that occur once cannot lie in a repeated window; the others are found by an exchange of hashes. Consecutive
windows with one anchor form a segment; segments of equal anchor meet in one bucket, each distinct segment once per block.
Anchors that very many blocks hold are split further by the place of the anchor in the window and by the bytes common to
all windows at that place, so a passage that a third of all documents hold is spread over many groups.

Suffix array. In a bucket, distinct segments are joined to one text and sorted in two stages: only suffixes smaller than
their successor are sorted directly; the others follow from them by scanning buckets of first bytes in order, since such
a suffix is its first byte before a suffix that is already placed. Common prefixes of neighbours of at least `width` bytes
are the repeats. Nothing outside window starts and what they need is sorted.

Cases: a null or empty text has no bytes; texts shorter than a window lose nothing; ids may be null or repeated, repeated
rows repeat each other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyvigil.llm.common import ID, KEY, TEXT, id_back, identified, gram_hashes, joined_bytes, mixed, partitions, span_hashes
from keyvigil.llm.repeats import block_number, in_buckets, repeated_units, text_blocks
from keyvigil.session import written

WIDTH = 200
GRAM = 16
CHUNK_BYTES = 2_000_000
SPLIT_AT = 2_000  # entries of one anchor in its bucket from which its segments are split further
STEP = 8
HOT = 1 << 31
NONE = np.uint64(2**64 - 1)


# ---- two-stage suffix sorting ----------------------------------------------------------------------------------------


def _words_at(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number in text order (zeros beyond the end)."""
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    word = np.zeros(len(text), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(text)]
    return word


def _beyond(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    inside = places < len(words)
    return np.where(inside, words[np.minimum(places, len(words) - 1)], np.uint64(0))


def _descending(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is greater than its successor (the empty one is the smallest)."""
    n = len(text)
    step = np.zeros(n, np.int16)
    step[:-1] = np.diff(text.astype(np.int16))
    step[-1] = -1
    change = np.where(step != 0, np.arange(n), n - 1)
    change = np.minimum.accumulate(change[::-1])[::-1]
    return step[change] < 0


def _sorted_directly(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The places ordered by their first `depth` bytes: by eight bytes, then only ties by the next eight."""
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    tie = np.zeros(len(order), bool)
    tie[1:] = key[1:] == key[:-1]
    group = np.cumsum(~tie)
    for offset in range(8, depth, 8):
        inside = tie.copy()
        inside[:-1] |= tie[1:]
        at = np.flatnonzero(inside)
        if not len(at):
            break
        key = _beyond(words, order[at] + offset)
        by = np.lexsort((key, group[at]))
        order[at] = order[at][by]
        key, label = key[by], group[at]
        same = np.zeros(len(at), bool)
        same[1:] = (key[1:] == key[:-1]) & (label[1:] == label[:-1])
        tie = np.zeros(len(order), bool)
        tie[at] = same
        group = np.cumsum(~tie)
    return order


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places (flags) in the order of the first `depth` bytes (at least) of their suffixes."""
    n = len(text)
    words = _words_at(text)
    falling = _descending(text)
    # A falling suffix needs the ones after it, up to the first that is sorted directly or the end.
    stop = np.where(falling, n, np.arange(n))
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    run = np.maximum.accumulate(np.where(wanted, stop, -1))
    needed = run >= np.arange(n)
    direct = _sorted_directly(words, np.flatnonzero(needed & ~falling), depth)
    first = text[direct]
    edges = np.searchsorted(first, np.arange(257))
    waiting: dict[int, list[np.ndarray]] = {}

    def induce(placed: np.ndarray) -> np.ndarray:
        """Files the falling predecessors of placed suffixes, in order; returns those of the same bucket."""
        before = placed[placed > 0] - 1
        before = before[falling[before] & needed[before]]
        heads = text[before]
        same = before[heads == byte]
        other = heads != byte
        before, heads = before[other], heads[other]
        by = np.argsort(heads, kind="stable")
        before, heads = before[by], heads[by]
        cuts = np.flatnonzero(np.diff(heads.astype(np.int16), prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(before))):
            waiting.setdefault(int(heads[a]), []).append(before[a:b])
        return same

    result = []
    if needed[n - 1] and falling[n - 1]:
        waiting[int(text[n - 1])] = [np.array([n - 1])]
    for byte in range(256):
        pending = waiting.pop(byte, [])
        placed = np.concatenate(pending) if pending else np.zeros(0, np.int64)
        while len(placed):
            result.append(placed)
            placed = induce(placed)
        placed = direct[edges[byte] : edges[byte + 1]]
        if len(placed):
            result.append(placed)
            induce(placed)
    order = np.concatenate(result) if result else np.zeros(0, np.int64)
    return order[wanted[order]]


def repeated_starts(text: np.ndarray, wanted: np.ndarray, width: int) -> np.ndarray:
    """Flags of the wanted places whose next `width` bytes also start at another wanted place."""
    order = suffix_order(text, wanted, width)
    words = _words_at(text)
    alike = np.arange(1, len(order))
    for offset in [*range(0, width - 8, 8), width - 8]:
        alike = alike[words[order[alike] + offset] == words[order[alike - 1] + offset]]
    flags = np.zeros(len(text), bool)
    flags[order[alike]] = True
    flags[order[alike - 1]] = True
    return flags


# ---- routing ---------------------------------------------------------------------------------------------------------


class _Anchors:
    """Segments of a block: runs of windows with one anchor, with the anchor's hash."""

    def __init__(self, texts: list[bytes], width: int):
        self.data, self.starts = joined_bytes(texts)
        n, gram = len(self.data), GRAM
        reach = width - gram + 1  # grams in a window
        if n < width:
            self._none(len(texts))
            return
        self.hashes = gram_hashes(self.data, gram)
        # The leading 32 bits of the hash, then the place: among equal ones the leftmost counts.
        low = np.uint64(0xFFFFFFFF)
        ranked = (self.hashes & ~low) | np.arange(len(self.hashes), dtype=np.uint64)
        best = self._sliding_min(ranked, reach)[: n - width + 1]
        place = (best & low).astype(np.int64)
        document = np.repeat(np.arange(len(texts)), np.diff(self.starts))[: n - width + 1]
        window = np.arange(n - width + 1)
        valid = window + width < self.starts[document + 1]  # the line feed after a text is not part of it
        new = np.ones(len(window), bool)
        new[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
        heads = np.flatnonzero(new & valid)
        stops = np.flatnonzero(np.append(new[1:] | ~valid[1:], True) & valid) + 1
        self.begin, self.end, self.anchor = heads, stops, place[heads]
        self.document = document[heads]
        self.first = np.searchsorted(self.document, np.arange(len(texts)))

    def _none(self, texts: int) -> None:
        self.begin = self.end = self.anchor = self.document = np.zeros(0, np.int64)
        self.hashes = np.zeros(0, np.uint64)
        self.first = np.zeros(texts, np.int64)

    @staticmethod
    def _sliding_min(values: np.ndarray, reach: int) -> np.ndarray:
        """The least of each `reach` neighbours: running minima from both ends of pieces of that length."""
        n = len(values)
        pieces = -(-n // reach)
        padded = np.full(pieces * reach, NONE, np.uint64)
        padded[:n] = values
        grid = padded.reshape(pieces, reach)
        forward = np.minimum.accumulate(grid, axis=1).ravel()
        backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(backward[: n - reach + 1], forward[reach - 1 : n])


def _anchor_units(width: int):
    def units(_: pa.RecordBatch, texts: list[bytes]):
        block = _Anchors(texts, width)
        hashes = block.hashes[block.anchor]
        return block.first, hashes & np.uint64(0xFFFFFFFF), np.arange(len(hashes)), hashes >> np.uint64(32)

    return units


SEGMENTS = "bucket int, block long, groups binary, lengths binary, segments binary, directory binary"
_OWNERS = np.dtype([("id", "<i8"), ("key", "<i8"), ("begin", "<u4"), ("segment", "<i4"), ("windows", "<i4")])
RUNS = f"{ID} long, {KEY} long, runs binary"


def _split(block: _Anchors, chosen: np.ndarray, hot: np.ndarray, width: int):
    """Begin, end (of window starts), group hash and document of each segment; hot ones cut by place and common bytes."""
    groups = block.hashes[block.anchor[chosen]]
    begin, end, document = block.begin[chosen], block.end[chosen], block.document[chosen]
    if not hot.any():
        return begin, end, groups, document
    parts = [(begin[~hot], end[~hot], groups[~hot], document[~hot])]
    anchor = block.anchor[chosen][hot]
    steps = (anchor - begin[hot]) // STEP - (anchor - (end[hot] - 1)) // STEP + 1
    owner = np.repeat(np.flatnonzero(hot), steps)
    top = (block.anchor[chosen][owner] - begin[owner]) // STEP
    step = top - (np.arange(len(owner)) - np.repeat(np.cumsum(steps) - steps, steps))
    at = block.anchor[chosen][owner]
    low = np.maximum(begin[owner], at - STEP * step - STEP + 1)
    high = np.minimum(end[owner], at - STEP * step + 1)
    core = at - STEP * step  # bytes [core, core + width - STEP + 1) are in every window of this step
    common = span_hashes(block.data.astype(np.uint64) + np.uint64(1), core, core + width - STEP + 1)
    parts.append((low, high, mixed(common ^ mixed(groups[owner] + step.astype(np.uint64))), document[owner]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _ragged(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return data[np.repeat(begin - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _segments(buckets: int, width: int):
    """Each block's distinct segments by bucket, and a directory of where each occurs."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            block = _Anchors(texts, width)
            marks = [np.frombuffer(m, "<u4").astype(np.int64) for m in batch.column(3).to_pylist()]
            chosen = np.concatenate([f + m % HOT for f, m in zip(block.first, marks)])
            hot = np.concatenate(marks) >= HOT
            begin, end, groups, document = _split(block, chosen, hot, width)
            lengths = end - begin + width - 1
            content = span_hashes(block.data.astype(np.uint64) + np.uint64(1), begin, begin + lengths)
            order = np.lexsort((content, groups))
            new = np.ones(len(order), bool)
            new[1:] = (content[order][1:] != content[order][:-1]) | (groups[order][1:] != groups[order][:-1])
            segment = np.zeros(len(order), np.int32)
            segment[order] = np.cumsum(new) - 1
            heads = order[new]
            copies = np.bincount(segment, minlength=len(heads))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            number = block_number(ids, keys)
            owners = np.zeros(len(order), _OWNERS)
            owners["id"], owners["key"] = ids[document], keys[document]
            owners["begin"], owners["segment"] = begin - block.starts[document], segment
            owners["windows"] = np.where(copies[segment] > 1, end - begin, -(end - begin))  # positive: all repeat here
            bucket = ((groups[heads] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            bucket, heads = bucket[by], heads[by]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = ([], [], [], [], [], [])
            for a, b in zip(cuts, np.append(cuts[1:], len(heads))):
                part = heads[a:b]
                numbers = np.arange(len(copies))[by[a:b]]
                fields = np.zeros((len(part), 3), "<i8")
                fields[:, 0], fields[:, 1] = groups[part].view(np.int64), content[part].view(np.int64)
                fields[:, 2] = numbers * 2 + (copies[numbers] > 1)
                for column, value in zip(rows, (
                    bucket[a], number, fields.tobytes(), lengths[part].astype("<u4").tobytes(),
                    _ragged(block.data, begin[part], lengths[part]).tobytes(), None,
                )):
                    column.append(value)
            for column, value in zip(rows, (number % buckets, number, b"", b"", b"", owners.tobytes())):
                column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(rows, kinds)],
                names=["bucket", "block", "groups", "lengths", "segments", "directory"],
            )

    return send


def _by_groups(batches: Iterator[pa.RecordBatch]):
    """Rows of one bucket at a time, sorted by bucket."""
    bucket, rows = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[0] != bucket and rows:
                yield rows
                rows = []
            bucket = row[0]
            rows.append(row)
    if rows:
        yield rows


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _compared(width: int):
    """Per block: segments whose windows repeat, as (segment, begin, end of window starts)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_groups(batches):
            blocks = [r[1] for r in rows if r[5] is not None]
            replies: list[bytes] = [b""] * len(blocks)
            directories: list[bytes | None] = [r[5] for r in rows if r[5] is not None]
            asked = [r for r in rows if r[5] is None]
            if asked:
                fields = np.concatenate([np.frombuffer(r[2], "<i8").reshape(-1, 3) for r in asked])
                lengths = np.concatenate([np.frombuffer(r[3], "<u4") for r in asked]).astype(np.int64)
                data = np.concatenate([np.frombuffer(r[4], np.uint8) for r in asked])
                owner = np.repeat(np.arange(len(asked)), [len(r[3]) // 4 for r in asked])
                begin = np.cumsum(lengths) - lengths
                found = _compare_segments(fields, lengths, begin, data, width)
                own = owner[found[:, 0]]
                by = np.argsort(own, kind="stable")
                found, own = found[by], own[by]
                found[:, 0] = fields[found[:, 0], 2] >> 1
                ends = np.searchsorted(own, np.arange(len(asked) + 1))
                for k, r in enumerate(asked):
                    if ends[k + 1] > ends[k]:
                        blocks.append(r[1])
                        replies.append(found[ends[k] : ends[k + 1]].astype("<i4").tobytes())
                        directories.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(replies, pa.binary()), pa.array(directories, pa.binary())],
                names=["block", "found", "directory"],
            )

    return compare


def _compare_segments(fields, lengths, begin, data, width) -> np.ndarray:
    """Rows (segment, begin, end) of repeated window starts; segments known to repeat in their own block are left out."""
    order = np.lexsort((fields[:, 1], fields[:, 0]))
    group, content = fields[order, 0], fields[order, 1]
    new = np.ones(len(order), bool)
    new[1:] = (group[1:] != group[:-1]) | (content[1:] != content[:-1])
    distinct = np.cumsum(new) - 1
    heads = order[new]
    copies = np.bincount(distinct) + np.bincount(distinct, weights=fields[order, 2] & 1).astype(np.int64)
    windows = lengths - width + 1
    results = []
    # Segments that are there twice repeat as a whole.
    whole = order[(copies[distinct] > 1) & ((fields[order, 2] & 1) == 0)]
    results.append(np.column_stack((whole, np.zeros(len(whole), np.int64), windows[whole])))
    # The others are compared inside their group; chunks hold whole groups. A group of one has nothing to compare with.
    head_group = fields[heads, 0]
    fresh = np.ones(len(heads), bool)
    fresh[1:] = head_group[1:] != head_group[:-1]
    number = np.cumsum(fresh) - 1
    alone = np.bincount(number)[number] == 1
    some_single = np.bincount(number, weights=copies == 1)[number] > 0
    active = np.flatnonzero(~alone & some_single)
    size = np.cumsum(lengths[heads[active]] + 1)
    at = 0
    while at < len(active):
        stop = int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES, side="right"))
        stop = max(stop, at + 1)
        while stop < len(active) and number[active[stop]] == number[active[stop - 1]]:
            stop += 1
        part = heads[active[at:stop]]
        once = copies[active[at:stop]] == 1
        sizes = lengths[part] + 1
        starts = np.cumsum(sizes) - sizes
        text = np.zeros(int(sizes.sum()), np.uint8)
        inner = np.repeat(starts, lengths[part]) + np.arange(lengths[part].sum()) - np.repeat(
            np.cumsum(lengths[part]) - lengths[part], lengths[part])
        text[inner] = _ragged(data, begin[part], lengths[part])
        edge = np.zeros(len(text) + 1, np.int32)
        edge[starts] += 1
        edge[starts + windows[part]] -= 1
        wanted = np.cumsum(edge[:-1]) > 0
        flags = repeated_starts(text, wanted, width)
        low, high = _runs(flags)
        owner = np.searchsorted(starts, low, side="right") - 1
        keep = once[owner]
        low, high, owner = low[keep], high[keep], owner[keep]
        results.append(np.column_stack((part[owner], low - starts[owner], high - starts[owner])))
        at = stop
    found = np.concatenate(results)
    return found[(fields[found[:, 0], 2] & 1) == 0]


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns found runs of segments into runs of window starts in each document they occur in."""
    for batch in batches:
        ids, keys, runs = [], [], []
        for lists, directory in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            owners = np.frombuffer(directory, _OWNERS)
            found = np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 3) for x in lists])
            found = found[np.argsort(found[:, 0], kind="stable")]
            begin = owners["begin"].astype(np.int64)
            whole = owners["windows"] > 0
            first = np.searchsorted(found[:, 0], owners["segment"], side="left")
            last = np.searchsorted(found[:, 0], owners["segment"], side="right")
            many = np.where(whole, 0, last - first)
            owner = np.repeat(np.arange(len(owners)), many)
            place = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            who = np.concatenate((np.flatnonzero(whole), owner))
            low = np.concatenate((begin[whole], begin[owner] + found[place, 1]))
            high = np.concatenate((begin[whole] + owners["windows"][whole], begin[owner] + found[place, 2]))
            by = np.lexsort((low, owners["key"][who], owners["id"][who]))
            who, low, high = who[by], low[by], high[by]
            new = np.ones(len(who), bool)
            new[1:] = (owners["id"][who][1:] != owners["id"][who][:-1]) | (owners["key"][who][1:] != owners["key"][who][:-1])
            cuts = np.flatnonzero(new)
            for a, b in zip(cuts, np.append(cuts[1:], len(who))):
                ids.append(owners["id"][who[a]])
                keys.append(owners["key"][who[a]])
                runs.append(np.column_stack((low[a:b], high[a:b])).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(runs, pa.binary())], names=[ID, KEY, "runs"]
        )


def repeated_runs(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Id, key and `runs`: pairs (begin, end) of window starts that repeat. `docs` is the result of `identified`."""
    marked = repeated_units(docs, _anchor_units(width), "<u4", "byte-anchors", SPLIT_AT)
    sent = docs.join(marked, [ID, KEY]).mapInArrow(_segments(partitions(docs), width), SEGMENTS)
    answers = in_buckets(sent).mapInArrow(_compared(width), "block long, found binary, directory binary")
    whole = answers.groupBy("block").agg(F.collect_list("found").alias("found"), F.first("directory", True).alias("directory"))
    runs = whole.select("found", "directory").mapInArrow(_by_document, RUNS)
    return written(runs.dropDuplicates([ID, KEY]), "byte-runs")


def removal(docs: DataFrame, runs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            gone, spans = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for k, found in enumerate(batch.column(2).to_pylist()):
                if found:
                    text = np.frombuffer(texts[k], np.uint8)
                    pairs = np.frombuffer(found, "<i8").reshape(-1, 2)
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, pairs[:, 0], 1)
                    np.subtract.at(edge, pairs[:, 1] + width - 1, 1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone[k] = len(text) - keep.sum()
                    spans[k] = len(_runs(~keep)[0])
                    texts[k] = text[keep].tobytes()
            n_bytes = gone + np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes), pa.array(gone), pa.array(spans), pa.array(texts, pa.binary())],
                names=[ID, "n_bytes", "n_removed", "n_spans", "kept"],
            )

    joined = docs.join(runs, [ID, KEY], "left").select(ID, TEXT, "runs")
    return joined.mapInArrow(remove, f"{ID} long, n_bytes long, n_removed long, n_spans long, kept binary")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept."""
    known = identified(docs, id_col, text_col)
    result = removal(known, repeated_runs(known, width), width)
    return result.select(id_back().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
