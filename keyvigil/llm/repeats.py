"""Which hashed units of a corpus occur more than once, answered per document.

A task reads documents in blocks of bounded size. Of each block it sends every distinct hash once, packed by bucket, so
a unit that a third of all documents hold costs one entry per block. Units that repeat inside the block are known there
and then. A bucket sorts the entries of all blocks and answers each block with the numbers of its repeated units; the
block's directory, sent along, turns these into places in documents.

Rows of an exchange: bucket, block, `rest` (hash bits beside the bucket), `units` (numbers of units, high bit: repeats in
its block) and, in one row per block, `directory`: its documents, and the units that repeat inside it with the number
that was sent for them. In answers the high bit says that very many blocks hold the unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyvigil.llm.common import ID, KEY, mixed, partitions, sub_blocks
from keyvigil.session import written

BLOCK_BYTES = 2_000_000
MANY = np.uint32(1 << 31)

SENT = "bucket int, block long, rest binary, units binary, directory binary"
MARKS = f"{ID} long, {KEY} long, marks binary"
_DIRECTORY = np.dtype([("id", "<i8"), ("key", "<i8"), ("first", "<i8")])


def text_blocks(batches: Iterator[pa.RecordBatch]):
    """Blocks of rows (a record batch slice and its texts as bytes); the columns are id, key, text and maybe more."""
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])
        for first, last in sub_blocks(lengths, BLOCK_BYTES):
            yield batch.slice(first, last - first), texts.slice(first, last - first).to_pylist()


def block_number(ids: np.ndarray, keys: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        each = mixed(ids.astype(np.uint64) * np.uint64(31) + keys.view(np.uint64)) * (
            np.arange(1, len(ids) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        )
        return int(mixed(np.array([each.sum(dtype=np.uint64)]))[0].astype(np.int64))


def sent_rows(batch: pa.RecordBatch, firsts: np.ndarray, hashes: np.ndarray, units: np.ndarray, bucket_of: np.ndarray,
              buckets: int, width: str) -> pa.RecordBatch:
    """One block's rows. firsts: number of the first unit of each document; units: numbers of the hashed units."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    keys = batch.column(1).to_numpy(zero_copy_only=False)
    block = block_number(ids, keys)
    rest = hashes.astype(width)
    bucket = (bucket_of % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((rest, bucket))
    bucket, rest = bucket[order], rest[order]
    new = np.ones(len(order), bool)
    new[1:] = (rest[1:] != rest[:-1]) | (bucket[1:] != bucket[:-1])
    heads = np.flatnonzero(new)
    copies = np.diff(np.append(heads, len(order)))
    again = np.repeat(copies > 1, copies)
    known = np.column_stack((units[order][again], np.repeat(units[order[heads]], copies)[again])).astype("<u4")
    sent = (units[order[heads]].astype(np.uint32) | np.where(copies > 1, MANY, np.uint32(0))).astype("<u4")
    bucket, rest = bucket[heads], rest[heads]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cuts, len(bucket))
    directory = np.zeros(len(ids), _DIRECTORY)
    directory["id"], directory["key"], directory["first"] = ids, keys, firsts
    n = len(cuts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.append(bucket[cuts], block % buckets).astype(np.int32)),
            pa.array(np.full(n + 1, block, np.int64)),
            pa.array([rest[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])] + [b""], pa.binary()),
            pa.array([sent[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])] + [b""], pa.binary()),
            pa.array([None] * n + [np.int64(len(ids)).tobytes() + directory.tobytes() + known.tobytes()], pa.binary()),
        ],
        names=["bucket", "block", "rest", "units", "directory"],
    )


def _groups(batches: Iterator[pa.RecordBatch]):
    """Rows of one bucket at a time; they come sorted by bucket."""
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


def _answered(width: str, many_blocks: int) -> Callable:
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            blocks, replies, directories = [], [], []
            asked = [r for r in rows if r[4] is None]
            for row in (r for r in rows if r[4] is not None):
                blocks.append(row[1])
                replies.append(b"")
                directories.append(row[4])
            if asked:
                rest = np.concatenate([np.frombuffer(r[2], width) for r in asked])
                units = np.concatenate([np.frombuffer(r[3], "<u4") for r in asked])
                owner = np.repeat(np.arange(len(asked)), [len(r[3]) // 4 for r in asked])
                order = np.argsort(rest, kind="stable")
                sorted_ = rest[order]
                new = np.ones(len(order), bool)
                new[1:] = sorted_[1:] != sorted_[:-1]
                copies = np.diff(np.append(np.flatnonzero(new), len(order)))
                copies = np.repeat(copies, copies)
                # Units that repeat in their block are known there; they only have to learn of very many blocks.
                single = (units[order] & MANY) == 0
                found = np.sort(order[(copies > 1) & single | (copies >= many_blocks)])
                units &= ~MANY
                units[order[copies >= many_blocks]] |= MANY
                ends = np.searchsorted(owner[found], np.arange(len(asked) + 1))
                for k, r in enumerate(asked):
                    if ends[k + 1] > ends[k]:
                        blocks.append(r[1])
                        replies.append(units[found[ends[k] : ends[k + 1]]].tobytes())
                        directories.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(replies, pa.binary()), pa.array(directories, pa.binary())],
                names=["block", "units", "directory"],
            )

    return answer


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, marks = [], [], []
        for lists, directory in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            told = np.concatenate([np.frombuffer(x, "<u4") for x in lists])
            count = np.frombuffer(directory, "<i8", 1)[0]
            docs = np.frombuffer(directory, _DIRECTORY, count, 8)
            known = np.frombuffer(directory, "<u4", offset=8 + docs.nbytes).reshape(-1, 2)
            hot = told[told >= MANY] & ~MANY
            places = np.concatenate((told & ~MANY, known[:, 0]))
            flags = np.concatenate((told & MANY, np.where(np.isin(known[:, 1], hot), MANY, np.uint32(0))))
            places, first = np.unique(places, return_index=True)
            flags = flags[first]
            ends = np.append(np.searchsorted(places, docs["first"]), len(places))
            for k in np.flatnonzero(np.diff(ends)):
                own = slice(ends[k], ends[k + 1])
                ids.append(docs["id"][k])
                keys.append(docs["key"][k])
                marks.append(((places[own] - np.uint32(docs["first"][k])) | flags[own]).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(marks, pa.binary())], names=[ID, KEY, "marks"]
        )


def in_buckets(sent: DataFrame) -> DataFrame:
    """One bucket per partition: the bucket's number is the partition's, so no two buckets meet by chance."""
    return sent.repartitionById(partitions(sent), F.col("bucket"))


def repeated_units(docs: DataFrame, units_of: Callable, width: str, name: str, many_blocks: int = 1 << 40) -> DataFrame:
    """Per document with repeated units: id, key and `marks`, the numbers (32 bits each) of these units in the document.

    units_of(batch, texts) gives, for a block: number of the first unit of each document, hashes, numbers of the hashed
    units, and hashes to choose buckets by. width: how many hash bits are compared beside the bucket ("<u4" or "<u8").
    Units that many_blocks blocks or more hold have the high bit of their mark set, everywhere.
    """
    buckets = partitions(docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            yield sent_rows(batch, *units_of(batch, texts), buckets, width)

    answers = in_buckets(docs.mapInArrow(send, SENT)).mapInArrow(_answered(width, many_blocks), "block long, units binary, directory binary")
    whole = answers.groupBy("block").agg(F.collect_list("units").alias("units"), F.first("directory", True).alias("directory"))
    marks = whole.select("units", "directory").mapInArrow(_by_document, MARKS)
    return written(marks.dropDuplicates([ID, KEY]), name)
