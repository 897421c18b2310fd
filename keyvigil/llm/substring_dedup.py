"""Substring dedup on words: difference-cover anchors find where long matches may be, hashed windows decide.

A window is `width` consecutive words. A difference cover D modulo v holds, for every shift, two elements that far apart.
So if a window occurs at p and at q, some d < v puts both p + d and q + d on cover positions, and the anchors there, of
width - v + 1 words, lie inside both windows and are equal. Only anchors at cover positions are hashed and exchanged;
an anchor that repeats is extended to the windows that contain it, and only those windows are compared.

Words are runs of characters other than space, tab and line ends, unchanged. Windows never cross documents, overlaps count,
and all windows are judged on the input. Windows are compared by 64 hash bits and the bucket chosen by another hash.

Cases: a null or empty text has no words; shorter texts than a window lose nothing; ids may be null or repeated, and
repeated rows are documents with equal windows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyvigil.llm.common import ID, KEY, TEXT, id_back, identified, joined_bytes, span_hashes, word_bounds
from keyvigil.llm.repeats import repeated_units

WIDTH = 35
# Perfect difference sets, modulus and elements.
COVERS = ((1, (0,)), (3, (0, 1)), (7, (0, 1, 3)), (13, (0, 1, 3, 9)), (21, (3, 6, 7, 12, 14)))
SECOND_BASE = 0xD6E8FEB86659FD93


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover whose anchors still have at least a third of the window's words."""
    return max(c for c in COVERS if c[0] == 1 or 3 * (width - c[0] + 1) >= width)


class _Block:
    """Word hashes of a block of texts: `first` is the number of each document's first word, `at` each word's place in it."""

    def __init__(self, texts: list[bytes]):
        data, starts = joined_bytes(texts)
        begin, end = word_bounds(data)
        self.hashes = span_hashes(data.astype(np.uint64) + np.uint64(1), begin, end)
        self.first = np.searchsorted(begin, starts[:-1])
        self.count = np.diff(np.append(self.first, len(begin)))
        self.at = np.arange(len(begin)) - np.repeat(self.first, self.count)
        self.left = np.repeat(self.count, self.count) - self.at

    def spans(self, chosen: np.ndarray, width: int, *base: int) -> np.ndarray:
        return span_hashes(self.hashes, chosen, chosen + width, *base)


def _marked(batch: pa.RecordBatch, size: int, firsts: np.ndarray) -> np.ndarray:
    """Flags of the block's units from the `marks` column."""
    flags = np.zeros(size, bool)
    for first, marks in zip(firsts, batch.column(3).to_pylist()):
        if marks:
            flags[first + np.frombuffer(marks, "<u4")] = True
    return flags


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Id, key and `marks`: numbers of the words at which a repeated window starts. `docs` is the result of `identified`."""
    period, cover = cover_for(width)
    anchor = width - period + 1
    on_cover = np.isin(np.arange(period), cover)

    def anchors(_: pa.RecordBatch, texts: list[bytes]):
        block = _Block(texts)
        chosen = np.flatnonzero(on_cover[block.at % period] & (block.left >= anchor))
        hashes = block.spans(chosen, anchor)
        return block.first, hashes & np.uint64(0xFFFFFFFF), chosen, hashes >> np.uint64(32)

    def windows(batch: pa.RecordBatch, texts: list[bytes]):
        block = _Block(texts)
        near = _marked(batch, len(block.at) + period, block.first)
        total = np.cumsum(near)
        total = np.concatenate(([0], total))
        n = len(block.at)
        candidate = (total[period : period + n] > total[:n]) & (block.left >= width)
        chosen = np.flatnonzero(candidate)
        return block.first, block.spans(chosen, width), chosen, block.spans(chosen, width, SECOND_BASE)

    found = repeated_units(docs, anchors, "<u4", "anchors")
    return repeated_units(docs.join(found, [ID, KEY]), windows, "<u8", "windows")


def removal(docs: DataFrame, marks: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_text (kept words joined by one space)."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, gone, kept = [], [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode().split()
                totals.append(len(words))
                if not marks:
                    gone.append(0)
                else:
                    steps = np.zeros(len(words) + 1, np.int32)
                    starts = np.frombuffer(marks, "<u4").astype(np.int64)
                    steps[starts] += 1
                    np.subtract.at(steps, starts + width, 1)
                    keep = np.cumsum(steps[:-1]) == 0
                    gone.append(len(words) - int(keep.sum()))
                    words = compress(words, keep.tolist())
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=[ID, "n_words", "n_removed", "kept_text"],
            )

    joined = docs.join(marks, [ID, KEY], "left").select(ID, TEXT, "marks")
    return joined.mapInArrow(remove, f"{ID} long, n_words long, n_removed long, kept_text string")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept_text."""
    known = identified(docs, id_col, text_col)
    result = removal(known, repeated_windows(known, width), width)
    return result.select(id_back().alias("doc_id"), "n_words", "n_removed", F.col("kept_text"))
