"""Best-fit packing of tokenised documents into sequences of fixed capacity, after a dominance reduction.

A piece's length is at most the capacity, so however many pieces there are, the packing problem is a table of counts per
length with at most `capacity` rows. That table is all the driver sees. On it,

1. the reduction fixes a set with a piece when it provably dominates every other set that could hold the piece
   (Martello and Toth): whatever else fits beside the piece can be swapped for the set's parts without loss;
2. the remainder is packed best-fit, longest first: each piece goes where the least room is left.

Both work on whole runs of equal lengths, so the plan is a bounded list of runs. Spark numbers the pieces of each length
(in slices of bounded size, so no length has to fit one task) and looks up the run each number falls into.

Cases: a null or empty text has only the end id; ids may be null or repeated, each row is packed; extra columns of the
pieces are carried along; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
from bisect import bisect_left, bisect_right, insort
from codecs import charmap_decode
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keyvigil.llm.common import joined_bytes, sub_blocks
from keyvigil.session import written

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
SLICE_ROWS = 50_000
BLOCK_BYTES = 3_000_000
WORDS_KEPT = 200_000

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
])


# ---- tokens ----------------------------------------------------------------------------------------------------------


# Kinds of bytes: letters, digits, white space and other ASCII characters; all else (apostrophes, other scripts) is 0.
_LETTER, _DIGIT, _OTHER, _SPACE = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[33:128] = _OTHER
_KIND[127] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[32, 9, 10, 11, 12, 13]] = _SPACE
_KIND[ord("'")] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Between which neighbours every text is cut before it is merged into ids: the tokenizer takes letters, single digits and
# other characters apart. Apostrophes may belong to either side, and so may bytes of other scripts.
_CUT = np.zeros((5, 5), bool)
_CUT[_LETTER, [_DIGIT, _OTHER, _SPACE]] = _CUT[[_DIGIT, _OTHER, _SPACE], _LETTER] = True
_CUT[_DIGIT, [_DIGIT, _OTHER, _SPACE]] = _CUT[[_OTHER, _SPACE], _DIGIT] = True
_CUT[_SPACE, [0, _OTHER]] = _CUT[[0, _OTHER], _SPACE] = True


# The same as tables for `bytes.translate`.
_KIND_OF, _LOWER_OF, _CUT_OF = _KIND.tobytes(), _LOWER.tobytes(), _CUT.tobytes().ljust(256, b"\0")

# One word for the tokenizer, whatever stands beside it: lower-case letters or signs, and letters of Latin-1 and Latin Extended A and B
# (but U+0130, which becomes two characters in lower case).
_PLAIN = re.compile(rb"[a-z]+|[!-&(-/:-@\[-`{-~]+")
_LATIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
# What the tokenizer does to a text before it merges, where single words may skip it.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
]}
_SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
# Byte-level vocabularies write a byte as a character: printable ones as themselves, the others from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = sorted({*range(256)} - _PRINTED)
_CHARACTERS = "".join(chr(byte if byte in _PRINTED else 256 + _OTHERS.index(byte)) for byte in range(256))


class _Words:
    """Ids of single words, as little-endian 32-bit values. The tokenizer never merges across the cuts above.

    Words that normalizing and splitting leave whole go straight to the vocabulary's merges; all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.merged = self.tokenizer.model.tokenize
        steps = [x and json.loads(x.__getstate__()) for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        self.direct = steps == [_NORMALIZER, _SPLITTER]
        self.special = [x.content.encode().lower() for x in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def one(self, word: bytes) -> bytes:
        text = word.decode()
        if not self.direct:
            own = None
        elif _PLAIN.fullmatch(word):
            own = text
        elif _LATIN.fullmatch(text):
            own = charmap_decode(text.lower().encode(), "strict", _CHARACTERS)[0]
        else:
            own = None
        ids = self.whole(text) if own is None else [token.id for token in self.merged(own)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, words: list[bytes]) -> list[bytes]:
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        found = list(map(known.get, words))
        for i, own in enumerate(found):
            if own is None:
                found[i] = known[words[i]] = self.one(words[i])
        return found


@lru_cache(1)
def _words(path: str) -> _Words:
    """A Python worker reads the vocabulary once, and keeps the words that it knows from one task to the next."""
    return _Words(path)


def _tokenised(texts: list[bytes], words: _Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, the end id after each text, and the place where each text begins."""
    data, starts = joined_bytes(texts)
    lowered = data.tobytes().translate(_LOWER_OF)
    data, kind = np.frombuffer(lowered, np.uint8), np.frombuffer(lowered.translate(_KIND_OF), np.uint8)
    begins = np.ones(len(data), bool)
    begins[1:] = np.frombuffer((kind[:-1] * np.uint8(len(_CUT)) + kind[1:]).tobytes().translate(_CUT_OF), bool)
    solid = kind != _SPACE
    begins &= solid
    offsets = np.append(np.cumsum(solid)[begins] - 1, solid.sum()).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[solid].tobytes())])
    coded = packed.dictionary_encode()
    each = [*words.ids(coded.dictionary.to_pylist()), np.array([end_id], "<u4").tobytes()]
    flat = np.frombuffer(b"".join(each), "<u4")
    sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
    places = np.cumsum(sizes) - sizes
    before = np.searchsorted(np.flatnonzero(begins), starts[1:])  # words up to the end of each text
    index = np.insert(coded.indices.to_numpy().astype(np.int64), before, len(each) - 1)
    counts = sizes[index]
    ends = np.cumsum(counts)
    ids = flat[np.repeat(places[index] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
    last = before + np.arange(len(texts))  # where each end id stands among the words
    bounds = np.concatenate(([0], ends[last])).astype(np.int64)
    if any(x in lowered for x in words.special):
        return _with_special(texts, words, end_id, ids, bounds)
    return ids, bounds


def _with_special(texts: list[bytes], words: _Words, end_id: int, ids: np.ndarray, bounds: np.ndarray):
    """The same where some text may hold the string of a special token: such a text goes to the tokenizer as a whole."""
    parts = [
        np.array([*words.whole(text.decode()), end_id], "<u4") if any(x in text.lower() for x in words.special) else ids[a:b]
        for text, a, b in zip(texts, bounds[:-1], bounds[1:])
    ]
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of `capacity` ids where longer: doc_id, piece, start, length, ids.

    `tokenizer` is a path, or the name of one of the installed public vocabularies.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        words = _words(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer))
        for whole in batches:
            column = pc.fill_null(whole.column(1), "").cast(pa.binary())
            for first, last in sub_blocks(pc.binary_length(column).to_numpy(zero_copy_only=False), BLOCK_BYTES):
                batch = whole.slice(first, last - first)
                ids, starts = _tokenised(column.slice(first, last - first).to_pylist(), words, end_id)
                lengths = np.diff(starts)
                parts = -(-lengths // capacity)
                doc = np.repeat(np.arange(len(lengths)), parts)
                part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                begin = starts[doc] + part * capacity
                end = np.minimum(begin + capacity, starts[doc + 1])
                offsets = pa.py_buffer((np.append(begin, len(ids)) * 4).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(doc), [None, offsets, pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc)), pa.array(part.astype(np.int32)),
                        pa.array(part * capacity), pa.array(end - begin), packed,
                    ],
                    names=PIECES.fieldNames(),
                )

    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return known.mapInArrow(cut, PIECES)


# ---- the plan on counts per length -----------------------------------------------------------------------------------


class _Stock:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int]):
        self.left = {size: n for size, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def give(self, size: int, n: int) -> None:
        if size not in self.left:
            insort(self.sizes, size)
        self.left[size] = self.left.get(size, 0) + n

    def largest(self, room: int) -> int | None:
        place = bisect_right(self.sizes, room)
        return self.sizes[place - 1] if place else None

    def smallest(self, n: int) -> list[float]:
        found: list[float] = []
        for size in self.sizes:
            found += [size] * min(n - len(found), self.left[size])
            if len(found) == n:
                return found
        return found + [math.inf] * (n - len(found))

    def best_pair(self, room: int) -> int:
        """Largest sum of two pieces within the room, 0 if there is none."""
        best, low, high = 0, 0, bisect_right(self.sizes, room) - 1
        while low <= high:
            total = self.sizes[low] + self.sizes[high]
            if total > room or (low == high and self.left[self.sizes[low]] < 2):
                high -= 1
            else:
                best = max(best, total)
                low += 1
        return best

    def best_second(self, room: int) -> int:
        """Largest possible shorter part of two pieces within the room, 0 if there is none."""
        for place in range(bisect_right(self.sizes, room // 2) - 1, -1, -1):
            size = self.sizes[place]
            partner = size if self.left[size] > 1 else self.sizes[place + 1] if place + 1 < len(self.sizes) else math.inf
            if size + partner <= room:
                return size
        return 0


def _dominating(stock: _Stock, size: int, capacity: int) -> tuple[int, ...] | None:
    """What to put beside one piece of this length (already taken out) so that no other choice can be better."""
    room = capacity - size
    first = stock.largest(room)
    if first is None:
        return ()
    small = stock.smallest(3)
    # It fills the room, or nothing fits beside it: it stands for all that could go in.
    if first == room or small[0] + small[1] > room:
        return (first,)
    if sum(small) <= room:
        return None  # three more may fit: no proof
    if first >= stock.best_pair(room):
        return (first,)
    stock.take(first, 1)
    second = stock.largest(room - first)
    stock.give(first, 1)
    return (first, second) if second is not None and second >= stock.best_second(room) else None


def reduction(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets that some best packing has, with how many sequences get each, and the counts of what is left."""
    stock, fixed, changed = _Stock(counts), [], True
    while changed:
        changed = False
        for size in sorted(stock.left, reverse=True):
            while stock.left.get(size):
                stock.take(size, 1)
                beside = _dominating(stock, size, capacity)
                stock.give(size, 1)
                if beside is None:
                    break
                need = Counter((size, *beside))
                times = min(stock.left[x] // n for x, n in need.items())
                for x, n in need.items():
                    stock.take(x, n * times)
                fixed.append(((size, *beside), times))
                changed = True
    return fixed, dict(stock.left)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Longest first, each where the least room is left. Returns (lengths with repeats, number of such sequences)."""
    open_: dict[int, list] = {}
    rooms: list[int] = []

    def add(content: tuple, number: int, room: int) -> None:
        if room not in open_:
            insort(rooms, room)
        open_.setdefault(room, []).append((content, number))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            place = bisect_left(rooms, size)
            if place < len(rooms):
                room = rooms[place]
                content, number = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    del rooms[place]
            else:
                room, content = capacity, ()
                number = -(-left // (capacity // size))
            each = room // size  # once a piece is in, the same sequence has the least room for the next
            full = min(number, left // each)
            rest = left - full * each if full < number else 0
            if full:
                add((*content, (size, each)), full, room - size * each)
            if rest:
                add((*content, (size, rest)), 1, room - size * rest)
            if number - full - (rest > 0):
                add(content, number - full - (rest > 0), room)
            left -= full * each + rest
    return [group for groups in open_.values() for group in groups]


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first number, end number, pieces per sequence, first sequence, offset in the sequence)."""
    fixed, rest = reduction(counts, capacity)
    groups = [(tuple(Counter(content).items()), times) for content, times in fixed] + best_fit(rest, capacity)
    used: Counter[int] = Counter()
    runs, sequence = [], 0
    for content, number in groups:
        offset = 0
        for size, each in content:
            runs.append((size, used[size], used[size] + each * number, each, sequence, offset))
            used[size] += each * number
            offset += each * size
        sequence += number
    return runs


RUNS = "length long, _from long, _to long, _each long, _sequence long, _offset long"


def packed(parts: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The parts (any columns, `length` among them) with sequence_id and offset. Call it on a stored table.

    Parts of one length are dealt out and numbered by the columns of `order`; those should tell rows apart.
    """
    spark = parts.sparkSession
    counts = {row["length"]: row["n"] for row in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    sizes = spark.createDataFrame(
        [(size, max(1, n // SLICE_ROWS)) for size, n in counts.items()], "length long, _slices long"
    )
    runs = spark.createDataFrame(packing_plan(counts, capacity), RUNS)
    # Both tables have a proven bound: a row per length, and a bounded number of runs per length.
    sliced = parts.join(F.broadcast(sizes), "length").withColumn("_slice", F.expr(f"pmod(xxhash64({', '.join(order)}), _slices)"))
    counted = sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    bases = counted.select("length", "_slice", F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("length", "_slice").orderBy(*order))
    numbered = sliced.withColumn("_within", within - 1).join(bases, ["length", "_slice"])
    number = F.col("_base") + F.col("_within")
    placed = numbered.withColumn("_number", number).join(F.broadcast(runs), "length").where("_number between _from and _to - 1")
    return placed.select(
        *parts.columns,
        F.expr("_sequence + (_number - _from) div _each").alias("sequence_id"),
        F.expr("_offset + ((_number - _from) % _each) * length").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY,
    keep_ids: bool = True,
) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and `ids` unless left out."""
    cut = pieces(docs, id_col, text_col, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids"))
    # Ids may be null or repeated: a stored row number tells the pieces apart.
    stored = written((cut if keep_ids else cut.drop("ids")).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    return packed(stored, capacity, ("doc_id", "piece", "_row")).drop("_row")
