"""Toxicity: cumulative-link ordinal regression over sparse text features, giving an expected severity.

P(grade > j) = sigmoid(w.x - t_j) with one weight vector w for all thresholds t_0 < t_1 < ... . x holds two values, the
logarithms of one plus count and of one plus count per hundred words, of the words and beginnings of words that toxic texts
hold clearly more often than others (a lower confidence bound of the log ratio of document shares, so what toxic and other
texts share never enters).

Labels say toxic or not. Grade 0 is not toxic; toxic texts are graded 1 to `GRADES` by equal shares of their evidence, the
number of those features per hundred words. Where a table has grades of its own, `fit` takes them as they are.

Training rows are bounded: at most `MOST_LABELLED` of each label, chosen by hash of the id; in the fit each stands for as many
labelled rows as its label has for each chosen one, so the base rate is that of all labels. Everything else covers all rows.

Cases: null or empty texts have no features and get the base severity; ids may be null or repeated; without toxic labels
every severity is 0; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyvigil.llm.common import ID, KEY, TEXT, id_back, identified, joined_bytes, span_hashes
from keyvigil.llm.repeats import text_blocks
from keyvigil.session import written

MOST_LABELLED = 10_000
MOST_FEATURES = 4096
LEAST_TEXTS = 5
LEAST_RATIO = 0.5  # natural logarithm, after the confidence margin
GRADES = 3
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes
LEAST_WORDS = 20  # shorter texts count as this long in densities
PENALTY = 3e-4
STEPS = 400

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of word beginnings, the text each belongs to, and the number of words of each text."""
    data, starts = joined_bytes([x.decode("utf-8", "replace").lower().encode() for x in texts])
    letter = _LETTER[data]
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if len(letter) and letter[0]:
        edges = np.concatenate((np.zeros(1, np.int64), edges))
    begin, end = edges[0::2], edges[1::2]
    values = data.astype(np.uint64) + np.uint64(1)
    document = np.searchsorted(starts, begin, side="right") - 1
    count = np.bincount(document, minlength=len(texts))
    hashes, owners = [span_hashes(values, begin, end)], [document]
    for size in BEGINNINGS:
        longer = end - begin > size
        hashes.append(span_hashes(values, begin[longer], begin[longer] + size) ^ np.uint64(0xA5A5A5A5))
        owners.append(document[longer])
    return np.concatenate(hashes), np.concatenate(owners), count


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts each feature occurs, added up per block."""
    for batch, texts in text_blocks(batches):
        hashes, document, _ = _features(texts)
        order = np.lexsort((document, hashes))
        hashes, document = hashes[order], document[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (document[1:] != document[:-1])
        hashes, document = hashes[new], document[new]
        toxic = batch.column(0).to_numpy(zero_copy_only=False)[document]
        values, place = np.unique(hashes, return_inverse=True)
        bad = np.bincount(place, weights=toxic, minlength=len(values)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(values.view(np.int64)), pa.array(bad), pa.array(np.bincount(place, minlength=len(values)) - bad)],
            names=["feature", "bad", "good"],
        )


def _sparse(texts: list[bytes], vocabulary: np.ndarray):
    """Text, feature number and count of all known features, and words per text."""
    hashes, document, words = _features(texts)
    size = max(len(vocabulary), 1)
    maybe = np.zeros(1 << 16, bool)
    maybe[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    near = maybe[(hashes >> np.uint64(48)).astype(np.int64)]
    hashes, document = hashes[near], document[near]
    place = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
    known = vocabulary[place] == hashes if len(vocabulary) else np.zeros(0, bool)
    cell, count = np.unique(document[known] * size + place[known], return_counts=True)
    return cell // size, cell % size, count, words


def _valued(row: np.ndarray, column: np.ndarray, count: np.ndarray, words: np.ndarray, size: int):
    """Cells of the matrix x: counts in the first `size` columns, densities in the others."""
    density = np.log1p(100 * count / np.maximum(words[row], LEAST_WORDS))
    return np.concatenate((row, row)), np.concatenate((column, column + size)), np.concatenate((np.log1p(count), density))


@dataclass
class Model:
    """Sorted feature hashes, shared weights (counts, then densities), and the thresholds between grades in rising order."""

    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """Probability of a grade above each threshold (rows: scores)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def fit(
    row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, vocabulary: np.ndarray, columns: int,
    weight: np.ndarray | None = None,
) -> Model:
    """Maximum likelihood with a quadratic penalty, by accelerated gradient steps over the whole (bounded) sample.

    weight: how many rows each row of the sample stands for (all alike if not given).
    """
    weight = np.ones(len(grade)) if weight is None else weight / weight.mean()
    top = int(grade.max()) if len(grade) else 0
    weights = np.zeros(columns)
    # Thresholds as a first one and logarithms of the gaps, so that they stay in order.
    shares = np.array([np.mean(weight * (grade > j)) for j in range(top)]) if top else np.zeros(0)
    start = np.log((1 - np.clip(shares, 1e-6, 1 - 1e-6)) / np.clip(shares, 1e-6, 1 - 1e-6))
    free = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    n = max(len(grade), 1)
    step_w, step_t = np.zeros_like(weights), np.zeros_like(free)
    moment_w, moment_t = np.zeros_like(weights), np.zeros_like(free)
    for turn in range(1, STEPS + 1 if top else 1):
        gaps = np.exp(free[1:])
        t = free[0] + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(row, weights=value * weights[column], minlength=len(grade))
        sigma = 1 / (1 + np.exp(np.clip(score[:, None] - t[None, :], -50, 50)))  # P(grade <= j)
        full = np.column_stack((np.zeros(len(grade)), sigma, np.ones(len(grade))))
        slope = np.column_stack((np.zeros(len(grade)), sigma * (1 - sigma), np.zeros(len(grade))))
        own = np.arange(len(grade))
        p = np.maximum(full[own, grade + 1] - full[own, grade], 1e-12)
        d_score = weight * (slope[own, grade + 1] - slope[own, grade]) / p  # of the negative log likelihood
        d_t = np.zeros((len(grade), top + 2))
        d_t[own, grade + 1] -= weight * slope[own, grade + 1] / p
        d_t[own, grade] += weight * slope[own, grade] / p
        d_t = d_t[:, 1 : top + 1].mean(axis=0)
        grad_w = np.bincount(column, weights=value * d_score[row], minlength=len(weights)) / n + PENALTY * weights
        grad_t = np.concatenate(([d_t.sum()], np.cumsum(d_t[::-1])[::-1][1:] * gaps))
        for grad, step, moment, target in ((grad_w, step_w, moment_w, weights), (grad_t, step_t, moment_t, free)):
            step *= 0.9
            step += 0.1 * grad
            moment *= 0.999
            moment += 0.001 * grad * grad
            target -= 0.05 * (step / (1 - 0.9**turn)) / (np.sqrt(moment / (1 - 0.999**turn)) + 1e-8)
    thresholds = free[:1] if not top else free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))
    return Model(vocabulary, weights, thresholds)


def known_labels(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").alias("_label_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "_label_id is not null and toxic is not null"
    ).distinct()


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """toxic, nothing, text of the bounded training sample (at most `most` rows of each label)."""
    known = known_labels(labels)
    part = lambda value: known.where(F.col("toxic") == value).orderBy(F.xxhash64("_label_id"), "_label_id").limit(most)
    chosen = F.broadcast(part(0).union(part(1)))  # 2 * most rows at the most
    # Ids may be repeated in the documents: one row per text, and the bound holds for rows too.
    rows = docs.join(chosen, docs["_doc_id"] == chosen["_label_id"]).dropDuplicates([ID, KEY, "toxic"])
    bounded = [rows.where(F.col("toxic") == value).orderBy(F.xxhash64(ID), ID, KEY).limit(most) for value in (0, 1)]
    return bounded[0].union(bounded[1]).select("toxic", F.lit(0).alias("_"), TEXT)


def trained(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """A model from the labelled texts among `docs` (the result of `identified`)."""
    rows = written(training_rows(docs, labels, most), "training-rows")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    counts = rows.mapInArrow(_counted, "feature long, bad long, good long").groupBy("feature").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    ratio = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    margin = 2 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    # A ratio of shares near 1 has a narrower margin than that of rare features.
    bound = ratio - margin
    best = (
        counts.where(F.col("bad") >= LEAST_TEXTS).withColumn("bound", bound).where(F.col("bound") > LEAST_RATIO)
        .orderBy(F.desc("bound"), "feature").limit(MOST_FEATURES).select("feature").collect()
    )
    vocabulary = np.sort(np.array([r["feature"] for r in best], np.int64).view(np.uint64))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            document, feature, count, words = _sparse(texts, vocabulary)
            ends = np.searchsorted(document, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(words.astype(np.int64)),
                    pa.array([feature[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])], pa.list_(pa.int32())),
                    pa.array([count[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])], pa.list_(pa.int32())),
                ],
                names=["toxic", "words", "features", "counts"],
            )

    sample = rows.mapInArrow(cells, "toxic int, words long, features array<int>, counts array<int>").collect()
    row = np.repeat(np.arange(len(sample)), [len(r["features"]) for r in sample])
    column = np.array([x for r in sample for x in r["features"]], np.int64)
    count = np.array([x for r in sample for x in r["counts"]], float)
    toxic = np.array([r["toxic"] for r in sample])
    words = np.array([r["words"] for r in sample], float)
    evidence = np.bincount(row, weights=count, minlength=len(sample)) / np.maximum(words, 1)
    cuts = np.quantile(evidence[toxic == 1], np.arange(1, GRADES) / GRADES)
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, evidence, side="right"), 0)
    # Labels are chosen by id, before documents are looked up: each chosen one stands for all / chosen of its label.
    total = {r["toxic"]: r["n"] for r in known_labels(labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    weight = np.where(toxic == 1, *(max(total.get(k, 0) / most, 1.0) for k in (1, 0)))
    return fit(*_valued(row, column, count, words, len(vocabulary)), grade, vocabulary, 2 * len(vocabulary), weight)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: id, expected severity, probability of any grade above 0, and the most probable grade."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            row, column, count, words = _sparse(texts, model.vocabulary)
            row, column, value = _valued(row, column, count, words, len(model.vocabulary))
            above = model.above(np.bincount(row, weights=value * model.weights[column], minlength=len(texts)))
            steps = np.column_stack((np.ones(len(texts)), above, np.zeros(len(texts))))
            grade = np.argmax(steps[:, :-1] - steps[:, 1:], axis=1)
            toxic = above[:, 0] if above.shape[1] else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(axis=1)), pa.array(toxic), pa.array(grade.astype(np.int32))],
                names=["_doc_id", "severity", "p_toxic", "grade"],
            )

    return docs.mapInArrow(score, "_doc_id long, severity double, p_toxic double, grade int")


def severities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, severity (expected grade), p_toxic, grade, and toxic (p_toxic at least one half)."""
    known = identified(docs, id_col, text_col)
    found = scored(known, trained(known, labels))
    return found.select(id_back().alias("doc_id"), "severity", "p_toxic", "grade", (F.col("p_toxic") >= 0.5).alias("toxic"))
