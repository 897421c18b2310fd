"""Near-duplicate classes: ProbMinHash signatures of weighted 5-word shingles, bands, exact verification, components.

A document's shingles are its runs of `SHINGLE` consecutive words (a shorter text is one shingle), weighted by how often
they occur. Each shingle is a Poisson process whose rate is its weight; every arrival picks one of the registers, and a
register keeps the shingle that arrives first. Two registers agree with the probability Jaccard similarity of the weights.
A document stops drawing as soon as no later arrival can be first anywhere. A document with repeated shingles is signed a second
time with all weights 1; those registers agree with the plain Jaccard similarity. Where nothing repeats the two are the same.

Documents with the same words are one node. Nodes that agree in all registers of a band of either signature share a bucket, and every pair of a
bucket is decided, but no bucket emits its pairs:

1. Star. Each node of a bucket is compared with the bucket's hub, the node that shares most buckets with others. Components of
   these links settle buckets of copies at once.
2. Rest. In a bucket that still holds several components, the nodes outside its largest one are compared with all its
   nodes, chunk against chunk inside tasks. Common shingles of all pairs of two chunks are one matrix product, so their
   plain similarity is exact for every pair; only links between components leave a task.

A pair is a link if the probability Jaccard similarity or the plain Jaccard similarity of its shingles is at least
`SIMILARITY`. Before a pair is verified by itself (with the hub, and in chunks where shingles repeat), the registers that
agree are counted, of either signature; where fewer than `SCREEN` do (five standard deviations below `SIMILARITY`), it is no
link. Links are joined to components on DataFrames.

Cases: a null or empty text, or one of white space, is a class of its own; a null id counts as the smallest id; repeated
rows are copies; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyvigil.llm.common import ID, KEY, LOWEST_ID, identified, joined_bytes, mixed, span_hashes, word_bounds
from keyvigil.llm.components import components
from keyvigil.llm.repeats import text_blocks
from keyvigil.session import written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5  # a pair of similarity 0.8 shares a band with probability 0.9999
CHUNK, CHUNK_BYTES = 128, 2 << 20  # nodes and bytes that a chunk holds on average
COLUMNS = 4096
BATCH_BYTES = 16 << 20
SCREEN = 0.62
SECOND_BASE = 0xD6E8FEB86659FD93

SIGNED = f"{ID} long, {KEY} long, n_words long, w1 long, w2 long, bands array<long>, sketch binary"


def _shingles(texts: list[bytes]):
    """Distinct shingle hashes with document and count, in order of document and hash; also words per document, hashes."""
    data, starts = joined_bytes(texts)
    begin, end = word_bounds(data)
    words = span_hashes(data.astype(np.uint64) + np.uint64(1), begin, end)
    first = np.searchsorted(begin, starts[:-1])
    count = np.diff(np.append(first, len(begin)))
    number = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    document = np.repeat(np.arange(len(texts)), number)
    at = first[document] + np.arange(len(document)) - np.repeat(np.cumsum(number) - number, number)
    hashes = span_hashes(words, at, at + np.minimum(count[document], SHINGLE))
    order = np.lexsort((hashes, document))
    hashes, document = hashes[order], document[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (document[1:] != document[:-1])
    heads = np.flatnonzero(new)
    weights = np.diff(np.append(heads, len(order)))
    last = first + count
    return hashes[heads], document[heads], weights, count, (
        span_hashes(words, first, last), span_hashes(words, first, last, SECOND_BASE)
    )


def signatures(hashes: np.ndarray, document: np.ndarray, weights: np.ndarray, documents: int, registers: int) -> np.ndarray:
    """The shingle that arrives first in each register, per document (a row each)."""
    arrival = np.full(documents * registers, np.inf)
    winner = np.zeros(documents * registers, np.uint64)
    time = np.zeros(len(hashes))
    turn = np.uint64(0)
    while len(hashes):
        turn += np.uint64(1)
        with np.errstate(over="ignore"):
            draw = mixed(hashes + turn * np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weights
        register = ((mixed(draw) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        place = document * registers + register
        np.minimum.at(arrival, place, time)
        first = time == arrival[place]
        winner[place[first]] = hashes[first]
        latest = arrival.reshape(documents, registers).max(axis=1)
        going = time < latest[document]
        hashes, document, weights, time = hashes[going], document[going], weights[going], time[going]
    return winner.reshape(documents, registers)


def _banded(winners: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each band and a byte for each register, a row per document."""
    flat = winners.ravel()
    begin = np.arange(0, len(flat), rows)
    band = np.tile(np.arange(bands, dtype=np.uint64), len(winners))
    keys = mixed(span_hashes(flat, begin, begin + rows) + band).view(np.int64).reshape(len(winners), bands)
    return keys, (winners & np.uint64(0xFF)).astype(np.uint8)


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: id, key, n_words, 128 hash bits of the word sequence, a hash for each band (none without words), and
    `sketch`, a byte of each register; where shingles repeat, bands and bytes of the unweighted registers follow."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            hashes, document, weights, count, (w1, w2) = _shingles(texts)
            keys, registers = _banded(signatures(hashes, document, weights, len(texts), bands * rows), bands, rows)
            lists = [x if n else [] for x, n in zip(keys.tolist(), count)]
            sketches = [row.tobytes() for row in registers]
            repeats = np.unique(document[weights > 1])
            if len(repeats):
                own = np.isin(document, repeats)
                plain = signatures(
                    hashes[own], np.searchsorted(repeats, document[own]), np.ones(own.sum(), np.int64), len(repeats), bands * rows
                )
                for k, more, row in zip(repeats.tolist(), *_banded(plain, bands, rows)):
                    lists[k] = list(dict.fromkeys(lists[k] + more.tolist()))
                    sketches[k] += row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(count.astype(np.int64)), pa.array(w1.view(np.int64)),
                    pa.array(w2.view(np.int64)), pa.array(lists, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
                ],
                names=[ID, KEY, "n_words", "w1", "w2", "bands", "sketch"],
            )

    return docs.mapInArrow(sign, SIGNED)


PACKED = "node long, shingles binary, weights binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node, sorted shingle hashes (32 bits) and their weights (none if all are 1)."""
    for batch, texts in text_blocks(batches):
        hashes, document, weights, *_ = _shingles(texts)
        short = (hashes >> np.uint64(32)).astype("<u4")  # still sorted
        ends = np.searchsorted(document, np.arange(len(texts) + 1))
        cuts = list(zip(ends[:-1], ends[1:]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([short[a:b].tobytes() for a, b in cuts], pa.binary()),
                pa.array([weights[a:b].astype("<u4").tobytes() if (weights[a:b] > 1).any() else None for a, b in cuts],
                         pa.binary()),
            ],
            names=["node", "shingles", "weights"],
        )


def similarities(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Probability Jaccard and plain Jaccard similarity of two weighted sets (sorted elements, weights)."""
    if not len(a) or not len(b):
        return 0.0, 0.0
    common, at, bt = np.intersect1d(a, b, return_indices=True)
    plain = len(common) / (len(a) + len(b) - len(common))
    if (x == 1).all() and (y == 1).all():
        return plain, plain
    # An element that only one side has counts for that side in every maximum.
    own_x, own_y = x.sum() - x[at].sum(), y.sum() - y[bt].sum()
    x, y = x[at].astype(float), y[bt].astype(float)
    order = np.argsort(x / y)[::-1]
    x, y = x[order], y[order]
    # In falling order of x / y, earlier elements count with x and later ones with y.
    left = np.cumsum(x) - x
    right = np.cumsum(y[::-1])[::-1]
    return float((1 / ((own_x + left) / x + (own_y + right) / y)).sum()), plain


def _weighted(shingles: bytes, weights: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    elements = np.frombuffer(shingles, "<u4")
    return elements, np.ones(len(elements), np.int64) if weights is None else np.frombuffer(weights, "<u4").astype(np.int64)


def _sketches(rows: list[bytes]) -> np.ndarray:
    """Weighted and unweighted registers of each row (row, signature, register); where only one is kept they are the same."""
    registers = BANDS * ROWS
    return np.frombuffer(b"".join(x if len(x) > registers else x + x for x in rows), np.uint8).reshape(len(rows), 2, registers)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, the larger of both signatures (last axis: a byte per register; bytes agree by chance
    once in 256)."""
    return (((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)).max(axis=-1)


def _screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (two first columns) whose sketches (two last columns) agree in enough registers."""
    for batch in batches:
        if batch.num_rows:
            sides = [_sketches(batch.column(k).to_pylist()) for k in (2, 3)]
            yield batch.select([0, 1]).filter(pa.array(_agreement(*sides) >= SCREEN))


def _linked(similarity: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*(column.to_pylist() for column in batch.columns[2:]))
            good = [max(similarities(*_weighted(s, v), *_weighted(t, w))) >= similarity for s, v, t, w in sides]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return link


def star_links(members: DataFrame, packed: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the hub of each bucket and its other nodes. members: bucket, node, hub."""
    side = lambda node, sketch: packed.select(F.col("node").alias(node), F.col("sketch").alias(sketch))
    pairs = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    close = pairs.join(side("b", "s_b"), "b").join(side("a", "s_a"), "a").select("a", "b", "s_a", "s_b")
    close = close.mapInArrow(_screened, "a long, b long")
    full = lambda node: packed.select(
        F.col("node").alias(node), F.col("shingles").alias(f"s_{node}"), F.col("weights").alias(f"w_{node}")
    )
    both = close.join(full("b"), "b").join(full("a"), "a").select("a", "b", "s_a", "w_a", "s_b", "w_b")
    return both.mapInArrow(_linked(similarity), "a long, b long")


def _chunk(rows: pa.StructArray) -> tuple:
    """Nodes, roots, shingles of all nodes in one array, the row of each shingle, weights and sketches of a chunk."""
    shingles = rows.field("shingles").to_pylist()
    row = np.repeat(np.arange(len(rows)), [len(x) // 4 for x in shingles])
    return (
        rows.field("node").to_numpy(), rows.field("root").to_numpy(), shingles, np.frombuffer(b"".join(shingles), "<u4"), row,
        rows.field("weights").to_pylist(), rows.field("sketch").to_pylist(),
    )


def _common(left: np.ndarray, left_row: np.ndarray, n: int, right: np.ndarray, right_row: np.ndarray, m: int) -> np.ndarray:
    """How many shingles every left node shares with every right one: a product of 0/1 matrices over the shingles that both
    sides hold, `COLUMNS` of them at a time."""
    shared = np.intersect1d(left, right)
    counts = np.zeros((n, m), np.float32 if len(shared) < 1 << 24 else np.float64)
    if len(shared):
        sides = []
        for values, row in ((left, left_row), (right, right_row)):
            place = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
            held = shared[place] == values
            order = np.argsort(place[held], kind="stable")
            sides.append((place[held][order], row[held][order]))
        for first in range(0, len(shared), COLUMNS):
            ones = []
            for (place, row), size in zip(sides, (n, m)):
                of = slice(*np.searchsorted(place, [first, first + COLUMNS]))
                matrix = np.zeros((size, min(COLUMNS, len(shared) - first)), np.float32)
                matrix[row[of], place[of] - first] = 1
                ones.append(matrix)
            counts += ones[0] @ ones[1].T
    return counts.astype(np.int64)


def similarities_to(
    a: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, row: np.ndarray, m: int
) -> np.ndarray:
    """Probability Jaccard similarity of one weighted set to each of m others, given in one array with the row of each element."""
    place = np.minimum(np.searchsorted(a, others), len(a) - 1)
    held = a[place] == others
    total = np.bincount(row, y, m)
    x, y, row, all_x = x[place[held]].astype(float), y[held].astype(float), row[held], x.sum()
    order = np.lexsort((-x / y, row))
    x, y, row = x[order], y[order], row[order]
    common_x, common_y = np.bincount(row, x, m), np.bincount(row, y, m)
    start = np.cumsum(np.bincount(row, minlength=m)) - np.bincount(row, minlength=m)
    before_x, before_y = (np.concatenate((np.zeros(1), np.cumsum(v))) for v in (x, y))
    left = before_x[:-1] - before_x[start[row]]
    right = common_y[row] - (before_y[:-1] - before_y[start[row]])
    own_x, own_y = (all_x - common_x)[row], (total - common_y)[row]
    return np.bincount(row, 1 / ((own_x + left) / x + (own_y + right) / y), m)


def _chunk_links(similarity: float):
    """Links between the nodes of two chunks that are in different components, until these are connected."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # one pair of chunks at a time
                (ones, one_roots, one_sets, left, left_row, one_weights, one_sketches), (
                    others, other_roots, other_sets, right, right_row, other_weights, other_sketches
                ) = (_chunk(batch.column(k)[row].values) for k in (0, 1))
                n, m = len(ones), len(others)
                common = _common(left, left_row, n, right, right_row, m)
                sizes = np.bincount(left_row, minlength=n)[:, None] + np.bincount(right_row, minlength=m)[None, :]
                apart = one_roots[:, None] != other_roots[None, :]
                close = apart & (common / (sizes - common) >= similarity)
                parent: dict[int, int] = {}

                def root(node: int) -> int:
                    while parent.get(node, node) != node:
                        node = parent[node]
                    return node

                found = []

                def joined(i: int, k: int, verified: bool) -> None:
                    a, b = root(int(one_roots[i])), root(int(other_roots[k]))
                    if a != b and (verified or max(similarities(
                        *_weighted(one_sets[i], one_weights[i]), *_weighted(other_sets[k], other_weights[k])
                    )) >= similarity):
                        parent[a] = b
                        found.append((int(ones[i]), int(others[k])))

                for i, k in np.argwhere(close).tolist():
                    joined(i, k, True)
                # Where shingles repeat, the weighted similarity may link what the plain one does not.
                heavy = [np.array([w is not None for w in side]) for side in (one_weights, other_weights)]
                if heavy[0].any() or heavy[1].any():
                    sketches = [_sketches(side) for side in (one_sketches, other_sketches)]
                    right_weights = np.concatenate([_weighted(*side)[1] for side in zip(other_sets, other_weights)])
                    for i in np.flatnonzero(apart.any(axis=1)).tolist():
                        ask = apart[i] & ~close[i] & (heavy[0][i] | heavy[1])
                        ask[ask] = _agreement(sketches[0][i][None], sketches[1][ask]) >= SCREEN
                        if ask.any():
                            own = ask[right_row]
                            exact = similarities_to(
                                *_weighted(one_sets[i], one_weights[i]), right[own], right_weights[own], right_row[own], m
                            )
                            # Sums in another order may differ in the last digits: the plain function has the last word.
                            for k in np.flatnonzero(ask & (exact >= similarity - 1e-9)).tolist():
                                joined(i, k, False)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"]
                    )

    return compare


def rest_links(members: DataFrame, roots: DataFrame, packed: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join components inside the buckets that still hold several."""
    rooted = members.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = rooted.join(packed.select("node", "size"), "node")
    parts = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    open_ = parts.groupBy("bucket").agg(
        F.count("*").alias("parts"), F.sum("n").alias("all"), F.sum("size").alias("bytes"),
        F.max(F.struct("n", "root", "size")).alias("largest"),
    ).where("parts > 1").select(
        "bucket", "all", "bytes", (F.col("all") - F.col("largest.n")).alias("outside"),
        (F.col("bytes") - F.col("largest.size")).alias("outside_bytes"), F.col("largest.root").alias("main"),
    )
    unsettled = written(rooted.drop("size").join(open_, "bucket"), "open-buckets").join(packed, "node")
    # Rows of two chunks are large: fewer of them at a time in a task.
    members.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    entry = F.struct("node", "root", "sketch", "shingles", "weights")

    def chunks(rows: DataFrame, size: Column, held: Column, name: str) -> DataFrame:
        wanted = F.greatest(F.ceil(size / F.lit(CHUNK)), F.ceil(held / F.lit(CHUNK_BYTES)), F.lit(1)).cast("long")
        number = F.pmod(F.xxhash64("node"), wanted)
        return rows.groupBy("bucket", number.alias("chunk")).agg(F.collect_list(entry).alias(name)).drop("chunk")

    outside = chunks(unsettled.where("root <> main"), F.col("outside"), F.col("outside_bytes"), "outside_nodes")
    every = chunks(unsettled, F.col("all"), F.col("bytes"), "nodes")
    return outside.join(every, "bucket").select("outside_nodes", "nodes").mapInArrow(_chunk_links(similarity), "a long, b long")


def links(nodes: DataFrame, packed_of, similarity: float = SIMILARITY) -> DataFrame:
    """Root of every node that has one other than itself. nodes: node, bands, sketch. packed_of(wanted nodes): shingles."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(rows.join(sizes, "bucket"), "band-members")
    degrees = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = shared.join(degrees, "node")
    # The hub as one number: highest degree, then smallest node.
    best = ranked.groupBy("bucket").agg(F.max("degree").alias("degree"))
    hubs = ranked.join(best, ["bucket", "degree"]).groupBy("bucket").agg(F.min("node").alias("hub"))
    members = written(shared.join(hubs, "bucket").drop("n"), "band-hubs")
    size = F.octet_length("shingles") + F.coalesce(F.octet_length("weights"), F.lit(0)) + F.octet_length("sketch")
    packed = packed_of(degrees.select("node")).join(nodes.select("node", "sketch"), "node").withColumn("size", size.cast("long"))
    packed = written(packed, "packed-shingles")
    star = written(star_links(members, packed, similarity), "star-links")
    roots = components(star)
    rest = written(rest_links(members, roots, packed, similarity), "rest-links")
    if rest.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest))


def _public(column: str) -> Column:
    return F.when(F.col(column) != LOWEST_ID, F.col(column))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of `docs` (the result of `identified`): id, key, n_words, class_id (the smallest id of its class) and `stays`.

    The one that stays has the smallest (id, key), so also among null or repeated ids it is one text; rows equal in both are
    copies of each other and get the same answer.
    """
    signs = written(signed(docs), "signatures")
    worded = signs.where("n_words > 0")
    nodes = written(
        worded.groupBy("w1", "w2").agg(
            F.min(F.struct(ID, KEY)).alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        ).withColumns({"least_id": F.col(f"least.{ID}"), "least_key": F.col(f"least.{KEY}")}).drop("least").withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )

    def packed_of(wanted: DataFrame) -> DataFrame:
        places = nodes.join(wanted, "node", "left_semi").select("node", F.col("least_id").alias(ID), F.col("least_key").alias(KEY))
        texts = docs.join(places, [ID, KEY]).select("node", KEY, "_doc_text")
        return texts.mapInArrow(_packed, PACKED).dropDuplicates(["node"])

    roots = links(nodes.select("node", "bands", "sketch"), packed_of, similarity)
    rooted = nodes.join(roots, "node", "left").select("w1", "w2", "least_id", "least_key", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min(F.struct("least_id", "least_key")).alias("least"))
    named = rooted.join(least, "root").select("w1", "w2", F.col("least.least_id").alias("class_id"), F.col("least.least_key").alias("_class_key"))
    stays = ((F.col(ID) == F.col("class_id")) & (F.col(KEY) == F.col("_class_key"))).alias("stays")
    return (
        worded.select(ID, KEY, "n_words", "w1", "w2").join(named, ["w1", "w2"]).select(ID, KEY, "n_words", "class_id", stays)
        .union(signs.where("n_words = 0").select(ID, KEY, "n_words", F.col(ID).alias("class_id"), F.lit(True).alias("stays")))
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, n_words, class_id and whether it is the document that stands for its class."""
    found = classes(identified(docs, id_col, text_col), similarity)
    return found.select(
        _public(ID).alias("doc_id"), "n_words", _public("class_id").alias("class_id"), "stays",
    )
