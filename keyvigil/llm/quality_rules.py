"""Quality rules: figures of each text, then boilerplate lines that too many documents of one host share.

Base rules fail a text with fewer than `MIN_WORDS` words or with more than half of its words in repeated 3-word windows.
The method: normalised lines are hashed, the distinct documents per host and line are counted, lines above the limit
are taken away, and a document of which too little is left is rejected.

* A line's normal form has no outer white space and is in lower case; lines without a word don't count.
* Documents of a host with the same text are one document, so exact copies never make their own text a boilerplate.
* A line is boilerplate in a host if more documents hold it than `LINE_LIMIT` and `LINE_SHARE` of the host's documents.
* The document that is the first (smallest id) to hold a boilerplate line keeps it, so no text goes with all its copies.
* A document is depleted if fewer than `MIN_WORDS` words are left and these are fewer than `MIN_SHARE` of its words.

Cases: a null or empty text has no words and fails; a null host is a host of its own; a null id is a document before all
others; repeated rows get the same result; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyvigil.llm.common import ID, KEY, LOWEST_ID, TEXT, WHITE, WHITE_RUN, id_back
from keyvigil.llm.line_dedup import BITS
from keyvigil.session import written

MIN_WORDS = 50
REPEAT_PERCENT = 50
LINE_LIMIT = 50
LINE_SHARE = 0.01
MIN_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
HOST = "_doc_host"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE_RUN, -1), lambda w: w != "")


def _with_repeated_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside 3-word windows that the array `_words` holds twice or more.

    Each window is one long: leading bits of its hash, then its start. Sorted, equal windows are neighbours; neighbours
    that agree in the leading bits are compared word by word. Each start then covers up to three words.
    """
    bits = "length(bin(size(_words)))"
    start = "cast({0} & (shiftleft(1L, _bits) - 1L) as int)"
    same = (
        "(shiftright({0}, _bits) = shiftright({1}, _bits) and "
        + " and ".join(f"_words[{start} + {k}] = _words[{start.replace('{0}', '{1}')} + {k}]" for k in range(3))
        + ")"
    )
    repeated = (
        "filter(_windows, (p, j) -> (j > 0 and " + same.format("p", "_windows[greatest(j - 1, 0)]") + ") or "
        "(j + 1 < size(_windows) and " + same.format("p", "_windows[least(j + 1, size(_windows) - 1)]") + "))"
    )
    covered = "transform(_starts, (s, j) -> if(j + 1 < size(_starts), least(3, _starts[least(j + 1, size(_starts) - 1)] - s), 3))"
    return (
        docs.withColumn("_bits", F.expr(bits).cast("int"))
        .withColumn(
            "_windows",
            F.expr(
                "array_sort(transform(slice(_words, 1, greatest(size(_words) - 2, 0)), (w, i) ->"
                " shiftleft(shiftright(xxhash64(w, _words[i + 1], _words[i + 2]), _bits), _bits) | cast(i as bigint)))"
            ),
        )
        .withColumn("_starts", F.expr(f"array_sort(transform({repeated}, p -> {start.format('p')}))"))
        .withColumn("n_repeat_words", F.expr(f"aggregate({covered}, 0L, (n, c) -> n + c)"))
    )


def text_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: base figures, base_failed, and `lines`, hash and word count of each line with a word."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    host = F.col(host_col).cast("string")
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST_ID)).alias(ID),
        F.xxhash64(text).alias(KEY),
        F.xxhash64(host.isNull(), F.coalesce(host, F.lit(""))).alias(HOST),
        text.alias(TEXT),
    )
    placed = F.transform(F.split(F.col(TEXT), "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    worded = F.filter(placed, lambda s: F.trim(s["x"], F.lit(WHITE)) != "")
    split = rows.withColumn("_words", _words(F.col(TEXT))).withColumn("_worded", worded)
    n_words = F.size("_words")
    failed = (n_words < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * n_words)
    lines = F.transform(
        "_worded",
        lambda s: F.struct(
            s["i"].alias("i"), F.xxhash64(F.lower(F.trim(s["x"], F.lit(WHITE)))).alias("h"), F.size(_words(s["x"])).alias("n")
        ),
    )
    return _with_repeated_words(split).select(
        ID, KEY, HOST,
        n_words.cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.length(F.regexp_replace(TEXT, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_worded") - F.size(F.array_distinct("_worded.x"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        lines.alias("lines"),
    )


def boilerplate(figures: DataFrame, limit: int = LINE_LIMIT, share: float = LINE_SHARE) -> DataFrame:
    """Lines above the limit: host, hash h, and first_id, the one document that keeps the line."""
    hosts = figures.select(HOST, KEY).distinct().groupBy(HOST).agg(F.count("*").alias("host_docs"))
    rows = figures.select(ID, KEY, HOST, F.explode("lines.h").alias("h"))
    texts = rows.groupBy(HOST, "h", KEY).agg(F.min(ID).alias("first_id"))
    counts = texts.groupBy(HOST, "h").agg(F.count("*").alias("docs"), F.min("first_id").alias("first_id"))
    above = counts.where(F.col("docs") > limit).join(hosts, HOST).where(F.col("docs") > share * F.col("host_docs"))
    return above.select(HOST, "h", "first_id")


def verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    limit: int = LINE_LIMIT, share: float = LINE_SHARE,
) -> DataFrame:
    """Per row: ID, KEY, the base figures, n_boilerplate (words in removed lines), base_failed, kept, and `drops`: a bitmap of the
    removed lines as `line_dedup` has them (null: none), from which `line_dedup.kept_text` makes the text that is left."""
    figures = written(text_figures(docs, id_col, text_col, host_col), "text-figures")
    common = boilerplate(figures, limit, share)
    lines = figures.select(ID, KEY, HOST, F.explode("lines").alias("line"))
    found = (
        lines.select(ID, KEY, HOST, F.col("line.i").alias("i"), F.col("line.h").alias("h"), F.col("line.n").alias("n"))
        .join(common, [HOST, "h"]).where(F.col(ID) != F.col("first_id"))
        .groupBy(ID, KEY, HOST, F.expr(f"i div {BITS}").cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, i % {BITS})")).alias("bits"), F.sum("n").alias("n"))
    )
    lost = found.groupBy(ID, KEY, HOST).agg(
        F.sum("n").alias("n_boilerplate"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("drops")
    )
    # Repeated rows (equal id, text and host) would each be counted in the sum: share it among them.
    again = figures.groupBy(ID, KEY, HOST).agg(F.count("*").alias("_rows")).where("_rows > 1")
    lost = (
        lost.join(again, [ID, KEY, HOST], "left")
        .withColumn("n_boilerplate", F.expr("n_boilerplate div coalesce(_rows, 1L)")).drop("_rows")
    )
    left = F.col("n_words") - F.col("n_boilerplate")
    depleted = (F.col("n_boilerplate") > 0) & (left < MIN_WORDS) & (left < MIN_SHARE * F.col("n_words"))
    return (
        figures.drop("lines").join(lost, [ID, KEY, HOST], "left")
        .withColumn("n_boilerplate", F.coalesce("n_boilerplate", F.lit(0)).cast("long"))
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
    )


def with_public_id(result: DataFrame) -> DataFrame:
    return result.select(
        id_back().alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_boilerplate",
    )
