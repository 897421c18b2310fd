"""Codebooks for vector parts by dual-tree Lloyd rounds, all in whole numbers.

Components become floor(scale * x). A vector is cut into equal consecutive parts; each part position has its own codebook.
Vectors are stored once in blocks of bounded size, and of each block and part position a tree: points halved along their
widest side down to leaves, with every node's box, count and sum. In each round a tree is put over the codebook entries
too, and both trees are walked together, level by level:

* a pair of nodes goes when its least possible distance exceeds the greatest possible one of another entry node;
* an entry goes when another one is at least as near at every place of the node's box;
* a node with one entry left gives that entry its stored count and sum as a whole;
* a leaf with several entries left compares its points with these, in whole numbers.

A round sends one sum per task and entry; the codebooks (parts x entries x width) are all the driver sees.

Cases: rows whose vector is null or holds null or non-finite components are left out; vectors of unequal width, or of one
that the parts don't divide, end in zeros up to the smallest common width that they do; ids may be null (they come after
all others in the choice of the first entries) or repeated (then the vector decides, ascending); fewer rows than entries
give as many entries as rows; no rows give no rows; other columns are not read. Components beyond `limit()` count as
that limit, so that every distance fits 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyvigil.llm.common import partitions
from keyvigil.session import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK_ROWS, BLOCK_VALUES, LEAF = 4096, 1 << 20, 32
PAIR_VALUES = 1 << 20
BLOCKS = "ids binary, no_id binary, labels binary, no_label binary, points array<binary>, orders array<binary>"
SUMS = "part int, entry int, place int, total long"
FOUND = "vec_id long, label long, code string, error long"


def limit(width: int) -> int:
    """Largest magnitude of a component for parts of this width: four parts' distances still fit 63 bits."""
    return math.isqrt((1 << 60) // max(width, 1)) // 2


# ---- trees ---------------------------------------------------------------------------------------------------------


def tree_levels(n: int, leaf: int) -> list[np.ndarray]:
    """Where the nodes of each level begin (and n at the end): every level halves the nodes of the one before."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max(initial=0) > leaf:
        bounds = levels[-1]
        middles = (bounds[:-1] + bounds[1:]) // 2
        both = np.empty(2 * len(bounds) - 1, np.int64)
        both[0::2], both[1::2] = bounds, middles
        levels.append(both)
    return levels


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the points in which every node of `tree_levels` is halved along the widest side of its box."""
    order = np.arange(len(points))
    for bounds in tree_levels(len(points), leaf)[:-1]:
        if not points.shape[1]:
            break
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a < 2:
                continue
            own = points[order[a:b]]
            side = int(np.argmax(own.max(0) - own.min(0)))
            order[a:b] = order[a:b][np.argpartition(own[:, side], (b - a) // 2)]
    return order


class Tree:
    """Boxes, sums and counts of all nodes over points in tree order."""

    def __init__(self, points: np.ndarray, leaf: int, sums: bool = True):
        self.points = points
        self.levels = tree_levels(len(points), leaf)
        self.boxes = []
        self.sums = []
        for bounds in self.levels:
            # An empty node (single points halved) takes the box of the point after it; walks leave it out.
            self.boxes.append((np.minimum.reduceat(points, bounds[:-1]), np.maximum.reduceat(points, bounds[:-1])))
            if sums:
                self.sums.append(np.add.reduceat(points, bounds[:-1]))


# ---- the walk over both trees ----------------------------------------------------------------------------------------


def _near_and_far(low_a, high_a, low_b, high_b):
    """Least and greatest squared distance between places of two boxes."""
    gap = np.maximum(np.maximum(low_b - high_a, low_a - high_b), 0)
    reach = np.maximum(high_b - low_a, high_a - low_b)
    return (gap * gap).sum(-1), (reach * reach).sum(-1)


def _in_slices(count: int, width: int):
    step = max(1, PAIR_VALUES // max(width, 1))
    return ((a, min(a + step, count)) for a in range(0, count, step))


def _bounds_of(pairs, boxes_p, boxes_e, width):
    near, far = np.empty(len(pairs[0]), np.int64), np.empty(len(pairs[0]), np.int64)
    for a, b in _in_slices(len(near), width):
        p, e = pairs[0][a:b], pairs[1][a:b]
        near[a:b], far[a:b] = _near_and_far(boxes_p[0][p], boxes_p[1][p], boxes_e[0][e], boxes_e[1][e])
    return near, far


def _dominated(nodes, entries, best, boxes_p, book, index, width):
    """Whether `best` is at least as near as the entry at every place of the node's box (ties go to the lower index)."""
    gone = np.zeros(len(nodes), bool)
    for a, b in _in_slices(len(nodes), width):
        p, e, z = nodes[a:b], entries[a:b], best[a:b]
        step = book[e] - book[z]
        # |x-z|^2 - |x-e|^2 is linear in x, so its greatest value is at a corner of the box.
        most = (np.maximum(2 * boxes_p[0][p] * step, 2 * boxes_p[1][p] * step) + book[z] ** 2 - book[e] ** 2).sum(-1)
        gone[a:b] = (most < 0) | ((most == 0) & (index[z] < index[e])) & (z != e)
    return gone


def _children(nodes: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), np.repeat(other, 2)


def walk(points: Tree, book: np.ndarray, whole, leaf) -> None:
    """Assign every point of the tree to the nearest row of `book`, ties to the lower row.

    whole(level, node, entry) takes whole nodes (arrays of equal length), leaf(first, last, entries) one leaf's points
    with the entries that are left for it, ascending.
    """
    width = book.shape[1]
    order = tree_order(book, 1)
    entries = Tree(book[order], 1, sums=False)
    ordered = book[order]
    held = np.diff(entries.levels[-1])
    depth_p, depth_e = len(points.levels) - 1, len(entries.levels) - 1
    level_p = level_e = 0
    nodes, others = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        near, far = _bounds_of((nodes, others), points.boxes[level_p], entries.boxes[level_e], width)
        heads = np.flatnonzero(np.diff(nodes, prepend=-1))
        sizes = np.diff(np.append(heads, len(nodes)))
        keep = near <= np.repeat(np.minimum.reduceat(far, heads), sizes)
        nodes, others, far = nodes[keep], others[keep], far[keep]
        if level_e == depth_e:
            # Entry nodes are single entries now: the one that reaches least far is held against the others.
            slots = entries.levels[-1][others]
            heads = np.flatnonzero(np.diff(nodes, prepend=-1))
            sizes = np.diff(np.append(heads, len(nodes)))
            by_far = np.lexsort((order[slots], far, nodes))
            best = np.repeat(slots[by_far[heads]], sizes)
            keep = ~_dominated(nodes, slots, best, points.boxes[level_p], ordered, order, width)
            nodes, others, slots = nodes[keep], others[keep], slots[keep]
            heads = np.flatnonzero(np.diff(nodes, prepend=-1))
            sizes = np.diff(np.append(heads, len(nodes)))
            sure = np.repeat(sizes == 1, sizes)
            whole(level_p, nodes[sure], order[slots[sure]])
            nodes, others = nodes[~sure], others[~sure]
            if not len(nodes):
                return
            if level_p == depth_p:
                break
        if level_e < depth_e:
            others, nodes = _children(others, nodes)
            level_e += 1
            if level_e == depth_e:  # halving single entries leaves empty nodes
                nodes, others = nodes[held[others] > 0], others[held[others] > 0]
        if level_p < depth_p:
            # Both children of a node keep its entries, and the pairs of a node stay together.
            heads = np.flatnonzero(np.diff(nodes, prepend=-1))
            sizes = np.diff(np.append(heads, len(nodes)))
            place = np.arange(len(nodes)) - np.repeat(heads, sizes)
            twice = np.repeat(sizes, 2)
            starts = np.cumsum(twice) - twice
            new_nodes = np.repeat(2 * np.repeat(nodes[heads], 2) + np.tile([0, 1], len(heads)), twice)
            picks = np.repeat(np.repeat(heads, 2), twice) + np.arange(len(new_nodes)) - np.repeat(starts, twice)
            nodes, others = new_nodes, others[picks]
            level_p += 1
    bounds = points.levels[depth_p]
    heads = np.flatnonzero(np.diff(nodes, prepend=-1))
    ends = np.append(heads[1:], len(nodes))
    for node, a, b in zip(nodes[heads].tolist(), heads.tolist(), ends.tolist()):
        leaf(int(bounds[node]), int(bounds[node + 1]), np.sort(order[entries.levels[-1][others[a:b]]]))


def nearest(points: np.ndarray, book: np.ndarray, exact_floats: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row of the nearest entry and its distance, in whole numbers (float arithmetic only where it holds them exactly)."""
    if exact_floats:
        dots = (points.astype(np.float64) @ book.T.astype(np.float64)).astype(np.int64)
    else:
        dots = points @ book.T
    far = (points * points).sum(1)[:, None] - 2 * dots + (book * book).sum(1)[None, :]
    pick = far.argmin(1)
    return pick, far[np.arange(len(points)), pick]


# ---- Spark -----------------------------------------------------------------------------------------------------------


def _whole_numbers(values: pa.Array, offsets: np.ndarray, width: int, parts: int, scale: int) -> np.ndarray:
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    rows = np.zeros((len(lengths), width), np.int64)
    most = limit(width // parts)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(flat * scale), -most, most).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    rows[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = whole
    return rows


def _block_writer(width: int, parts: int, scale: int):
    most = int(min(BLOCK_ROWS, max(64, BLOCK_VALUES // max(width, 1))))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, most):
                part = batch.slice(first, most)
                vectors = part.column(1)
                offsets = vectors.offsets.to_numpy()
                rows = _whole_numbers(vectors.flatten(), offsets, width, parts, scale)
                points, orders = [], []
                for own in np.split(rows, parts, axis=1):
                    order = tree_order(own, LEAF)
                    orders.append(order.astype("<i4").tobytes())
                    points.append(own[order].astype("<i4").tobytes())
                columns = []
                for k in (0, 2):
                    column = part.column(k)
                    columns += [column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
                                column.is_null().to_numpy(zero_copy_only=False).tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([c], pa.binary()) for c in columns), pa.array([points], pa.list_(pa.binary())),
                     pa.array([orders], pa.list_(pa.binary()))],
                    names=["ids", "no_id", "labels", "no_label", "points", "orders"],
                )

    return write


def _trees(row_points: list[bytes], n: int, width: int, sums: bool):
    for part, raw in enumerate(row_points):
        yield part, Tree(np.frombuffer(raw, "<i4").reshape(n, width).astype(np.int64), LEAF, sums)


def _summed(books: np.ndarray, exact_floats: bool):
    """One task's count and sum of every entry, as (part, entry, place, total); place -1 is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        sums = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            for ids, points in zip(batch.column(0), batch.column(1).to_pylist()):
                n = len(ids.as_buffer()) // 8
                for part, tree in _trees(points, n, width, True):
                    def whole(level, nodes, found, part=part, tree=tree):
                        np.add.at(sums[part], found, tree.sums[level][nodes])
                        np.add.at(counts[part], found, np.diff(tree.levels[level])[nodes])

                    def leaf(first, last, left, part=part, tree=tree):
                        own = tree.points[first:last]
                        pick = left[nearest(own, books[part][left], exact_floats)[0]]
                        np.add.at(sums[part], pick, own)
                        np.add.at(counts[part], pick, 1)

                    walk(tree, books[part], whole, leaf)
        part, entry = np.nonzero(counts)
        table = np.concatenate((counts[part, entry][:, None], sums[part, entry]), axis=1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(part, width + 1).astype(np.int32)),
                pa.array(np.repeat(entry, width + 1).astype(np.int32)),
                pa.array(np.tile(np.arange(-1, width), len(part)).astype(np.int32)),
                pa.array(table.reshape(-1)),
            ],
            names=["part", "entry", "place", "total"],
        )

    return run


def _coded(books: np.ndarray, exact_floats: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                codes = np.zeros((len(ids), len(books)), np.int64)
                error = np.zeros(len(ids), np.int64)
                for part, tree in _trees(row["points"], len(ids), books.shape[2], False):
                    found = np.zeros(len(ids), np.int64)

                    def whole(level, nodes, entry, tree=tree, found=found):
                        bounds = tree.levels[level]
                        for a, b, e in zip(bounds[nodes].tolist(), bounds[nodes + 1].tolist(), entry.tolist()):
                            found[a:b] = e

                    def leaf(first, last, left, part=part, tree=tree, found=found):
                        found[first:last] = left[nearest(tree.points[first:last], books[part][left], exact_floats)[0]]

                    walk(tree, books[part], whole, leaf)
                    order = np.frombuffer(row["orders"][part], "<i4")
                    codes[order, part] = found
                    error[order] += ((tree.points - books[part][found]) ** 2).sum(1)
                digits = max(2, len(f"{books.shape[1] - 1:x}"))
                texts = ["".join(f"{x:0{digits}x}" for x in one) for one in codes.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64(), mask=np.frombuffer(row["no_id"], bool)),
                        pa.array(labels, pa.int64(), mask=np.frombuffer(row["no_label"], bool)),
                        pa.array(texts, pa.string()),
                        pa.array(error),
                    ],
                    names=["vec_id", "label", "code", "error"],
                )

    return run


def _with_label_error(coded: DataFrame) -> DataFrame:
    """The error summed over rows of equal label. Fewer labels than partitions can hold more than a partition's share of
    the rows: these are broadcast, all others are joined by label."""
    pieces = partitions(coded)
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    rows = sums.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    marked = sums.withColumnRenamed("label", "_label")
    hot = F.broadcast(marked.where(F.col("_n") * pieces > rows))
    same = F.col("label").eqNullSafe(F.col("_label"))
    columns = [*coded.columns, "label_error"]
    of_hot = coded.join(hot, same).select(*columns)
    others = coded.join(hot, same, "left_anti")
    return of_hot.unionByName(others.join(marked.where(F.col("_n") * pieces <= rows), same).select(*columns))


def codebooks(
    stored: DataFrame, first: np.ndarray, rounds: int = ROUNDS, exact_floats: bool = False
) -> np.ndarray:
    """The codebooks (parts, entries, width) after the rounds, over stored blocks."""
    books = first
    for _ in range(rounds):
        sums = stored.select("ids", "points").mapInArrow(_summed(books, exact_floats), SUMS)
        total = F.sum(F.col("total").cast("decimal(20,0)")).alias("total")
        # Bounded by parts x entries x (width + 1) rows, whatever the data.
        table = {(r.part, r.entry, r.place): int(r.total) for r in sums.groupBy("part", "entry", "place").agg(total).collect()}
        books = books.copy()
        for (part, entry, place), value in table.items():
            if place >= 0:
                books[part, entry, place] = value // table[part, entry, -1]
    return books


def compressed(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """Per kept vector: vec_id, label, code (hex digits of its entries), error, label_error, codebooks_sha256."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        F.col(label_col).cast("long").alias("label"),
    ).where(F.col("vector").isNotNull() & F.forall("vector", finite))
    sizes = kept.agg(
        F.max(F.size("vector")).alias("widest"), F.max(F.array_max(F.transform("vector", F.abs))).alias("largest")
    ).first()
    width = -(-(sizes["widest"] or 0) // parts) * parts
    firsts = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not firsts:
        return kept.sparkSession.createDataFrame([], f"{FOUND}, label_error long, codebooks_sha256 string")
    stored = written(kept.mapInArrow(_block_writer(width, parts, scale), BLOCKS), "vector-blocks")
    lists = pa.array([r["vector"] for r in firsts], pa.list_(pa.float64()))
    start = _whole_numbers(lists.flatten(), lists.offsets.to_numpy(), width, parts, scale)
    books = np.stack(np.split(start, parts, axis=1))
    # Whole numbers up to 2**53 are exact in floats; a dot product of two parts stays below width x square of the largest.
    most = scale * (sizes["largest"] or 0.0) + 1
    exact_floats = (width // parts) * most * most < 2**52
    books = codebooks(stored, books, rounds, exact_floats)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    coded = written(stored.mapInArrow(_coded(books, exact_floats), FOUND), "vector-codes")
    return _with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest))
