"""Expressions and numpy helpers that several corpus operators share.

A document is a row with an id and a text. Ids may be null or repeated, so results that go back to the documents are
keyed by `ID` and `KEY`: the id (a null id sorts before all others) and a fingerprint of the text. Rows that agree in
both hold the same text, so whatever is decided for one of them is right for each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
ID, KEY, TEXT = "_doc_id", "_doc_key", "_doc_text"
LOWEST_ID = -(2**63)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, key and text (null becomes empty) under names of our own; any other column is left out."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST_ID)).alias(ID),
        F.xxhash64(text).alias(KEY),
        text.alias(TEXT),
    )


def id_back() -> Column:
    """The id as it came: null again where it was null."""
    return F.when(F.col(ID) != LOWEST_ID, F.col(ID))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters unchanged."""
    upper = "".join(map(chr, range(65, 91)))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# ---- numpy side: whole blocks of texts as one byte array -------------------------------------------------------------

_MASK = 2**64 - 1
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _inverse(base: int) -> int:
    value = base
    for _ in range(6):
        value = value * (2 - base * value) & _MASK
    return value


def powers(count: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below count (kept between calls)."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < count:
        size = max(count, 1 << 16)
        made = []
        for factor in (base, _inverse(base)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        known = _POWERS[base] = (made[0], made[1])
    return known[0][:count], known[1][:count]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    values = values ^ (values >> np.uint64(33))
    values *= np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every span, from one running sum."""
    up, down = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes from each place that has so many."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mixed((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, a line feed after each, and the place where each begins (one place more than texts)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), starts


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each maximal run without white space begins and ends. The data must end in white space or be empty."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    white = _IS_WHITE[data]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edges = np.concatenate((np.zeros(1, np.int64), edges))
    return edges[0::2], edges[1::2]


def sub_blocks(lengths: np.ndarray, most: int):
    """Slices of consecutive texts of about `most` bytes together; a longer text is a slice of its own."""
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield first, last
        first = last
