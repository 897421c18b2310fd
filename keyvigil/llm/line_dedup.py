"""Line dedup: hashed lines, range partitions with a secondary sort, compressed keep bitmaps per document.

A line's key is the line without outer white space, A-Z in lower case. Keys of `min_chars` code points or more that at
least two documents hold lose their lines in all documents but the one with the smallest id (which keeps all of them).

Cases: a null or empty text is one empty line; a null id counts as a document before all others; rows that share an id
are one document, so they never drop each other's lines; repeated rows all get the same result; an empty table gives no
rows. Keys are compared by 128 hash bits. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyvigil.llm.common import ID, KEY, TEXT, WHITE, ascii_lower, id_back, identified
from keyvigil.session import written

MIN_CHARS = 10
BITS = 64


def _lines():
    return F.split(F.col(TEXT), "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line that is long enough: 128 bits of its key, document, position."""
    each = docs.select(ID, KEY, F.posexplode(_lines()).alias("pos", "line"))
    key = ascii_lower(F.trim(F.col("line"), F.lit(WHITE)))
    return (
        each.withColumn("line", key)
        .where(F.length("line") >= min_chars)
        .select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), ID, KEY, "pos")
    )


def sorted_slices(lines: DataFrame) -> DataFrame:
    """The lines in order of hash, document, position, cut into slices of like size.

    A line that a third of all documents hold simply fills several slices, as document and position are part of the order.
    """
    order = ("h1", "h2", ID, "pos", KEY)
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.withColumn("slice", F.spark_partition_id()), "line-slices")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document that loses lines: `drops`, the non-zero 64-bit words (word, bits) of its drop bitmap, in order.

    The keep bitmap is its complement: lines of words that are not listed all stay, as do documents without a row.
    `docs` is the result of `identified`.
    """
    slices = sorted_slices(written(hashed_lines(docs, min_chars), "line-hashes"))
    line = ["h1", "h2"]
    heads = slices.groupBy("slice", *line).agg(F.min(ID).alias("low"), F.max(ID).alias("high"))
    shared = (
        heads.groupBy(*line).agg(F.min("low").alias("first_id"), F.max("high").alias("last_id"))
        .where("first_id < last_id").drop("last_id")
    )
    firsts = heads.select("slice", *line).join(shared, line)
    dropped = slices.join(firsts, ["slice", *line]).where(F.col(ID) != F.col("first_id"))
    words = dropped.groupBy(ID, KEY, F.expr(f"pos div {BITS}").cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, pos % {BITS})")).alias("bits")
    )
    return words.groupBy(ID, KEY).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def kept_text(text: Column) -> Column:
    """The text without the lines whose bits are set in the column `drops` (which must not be null)."""
    dense = (
        f"transform(sequence(0, array_max(drops.word)),"
        " w -> coalesce(element_at(map_from_entries(drops), cast(w as int)), 0L))"
    )
    flags = F.expr(f"flatten(transform({dense}, w -> transform(sequence(0, {BITS - 1}), b -> shiftright(w, b) & 1L)))")
    # The shorter list of flags is filled up with nulls; array_join leaves nulls out.
    lines = F.split(text, "\n", -1)
    return F.array_join(
        F.zip_with(lines, flags, lambda line, gone: F.when(F.coalesce(gone, F.lit(0)) == 0, line)), "\n"
    )


def with_kept_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Id, key, n_lines, n_dropped and kept_text, the remaining lines joined by a line feed."""
    lost = F.expr("aggregate(drops, 0L, (n, w) -> n + bit_count(w.bits))")
    kept = F.when(F.col("drops").isNull(), F.col(TEXT)).otherwise(kept_text(F.col(TEXT)))
    return docs.join(bitmaps, [ID, KEY], "left").select(
        ID, KEY,
        F.size(_lines()).cast("long").alias("n_lines"),
        F.coalesce(lost, F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped and kept_text."""
    known = identified(docs, id_col, text_col)
    result = with_kept_text(known, keep_bitmaps(known, min_chars))
    return result.select(id_back().alias("doc_id"), "n_lines", "n_dropped", "kept_text")
