"""Operators with a fixed contract against its plain reading."""

from __future__ import annotations

import re
from functools import partial

import brute
import edges
import pytest
from pyspark.sql import functions as F

from keyvigil.llm import line_dedup, personal_data, quality_rules, substring_dedup, suffix_dedup
from keyvigil.llm.common import identified

FOLDER = "/root/testdata/sf0.001"


def lines(docs):
    found = line_dedup.deduplicated(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("sha"))


def words(docs):
    return substring_dedup.deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("sha"))


def suffixes(docs):
    return suffix_dedup.deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))


def figures(docs):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return quality_rules.with_public_id(quality_rules.verdicts(docs)).select("doc_id", *columns)


def _is(kind, span):
    return span["kind"] == kind


def spans(docs):
    found = personal_data.personal_data(docs)
    base = F.filter("found", lambda s: s["kind"].isin(*personal_data.BASE_KINDS))
    counts = [F.size(F.filter("found", partial(_is, k))).alias(k) for k in personal_data.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(personal_data.listed(base), 256).alias("sha"))


CASES = {
    "lines": (lines, brute.line_dedup), "words": (words, brute.substring_dedup), "bytes": (suffixes, brute.byte_dedup),
    "figures": (figures, brute.quality_figures), "spans": (spans, brute.personal_data),
}


@pytest.mark.parametrize("name", CASES)
def test_odd_cases(spark, name):
    query, plain = CASES[name]
    rows = edges.texts()
    assert {r[0]: tuple(r[1:]) for r in query(edges.frame(spark, rows)).collect()} == plain(rows)


@pytest.mark.parametrize("name", CASES)
def test_given_documents(spark, name):
    query, plain = CASES[name]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r[0]: tuple(r[1:]) for r in query(docs.repartition(3)).collect()} == plain(rows)


@pytest.mark.parametrize("name", CASES)
def test_no_rows(spark, name):
    assert CASES[name][0](edges.frame(spark, [], 1)).count() == 0


@pytest.mark.parametrize("name", CASES)
def test_null_and_repeated_ids(spark, name):
    """Every row gets a result, and equal rows get equal ones."""
    rows = [(None, "some words that are here " * 20), (7, "z " * 80), (7, "z " * 80), (7, "other text " * 30), (None, None)]
    found = CASES[name][0](edges.frame(spark, rows)).collect()
    assert len(found) == 5
    assert sorted(str(r[0]) for r in found) == ["7", "7", "7", "None", "None"]


def test_windows_of_copies_go_and_unique_ones_stay(spark):
    text = " ".join(f"w{i}" for i in range(40))
    found = {r["doc_id"]: r["n_removed"] for r in substring_dedup.deduplicated(
        edges.frame(spark, [(1, text), (2, text), (3, text[:-2] + "no"), (4, " ".join(f"v{i}" for i in range(40)))])).collect()}
    assert found == {1: 40, 2: 40, 3: 39, 4: 0}


def test_hot_anchors_are_split(spark, monkeypatch):
    """With every anchor treated as one that very many blocks hold, the result is the same."""
    monkeypatch.setattr(suffix_dedup, "SPLIT_AT", 1)
    rows = edges.texts()
    assert {r[0]: tuple(r[1:]) for r in suffixes(edges.frame(spark, rows)).collect()} == brute.byte_dedup(rows)


def test_a_boilerplate_line_stays_in_its_first_document(spark):
    common = " ".join(f"b{i}" for i in range(60))
    rows = [(i * 3, f"{common}\nown {i}") for i in range(1, 80)] + [(300, " ".join(f"u{i}" for i in range(90)))]
    frame = edges.frame(spark, rows).withColumn("source", F.lit("one"))
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(frame).select(F.col("_doc_id").alias("doc_id"), "kept").collect()}
    assert sorted(i for i, k in kept.items() if k) == [3, 300]


def test_the_lines_of_a_boilerplate_are_removed(spark):
    common = " ".join(f"b{i}" for i in range(9))
    own = lambda i: "\n".join(f"word{i} " * 3 + " ".join(f"u{i}x{k}y{j}" for j in range(30)) for k in range(3))
    texts = {i: f"{common}\n\n{own(i)}\n {common.upper()}\t\nend {i}" for i in range(70)}
    frame = edges.frame(spark, [*texts.items(), (7, texts[7]), (None, "b0 " + own(99))]).withColumn("source", F.lit("one"))
    verdicts = quality_rules.verdicts(frame)
    known = identified(frame)
    joined = known.join(verdicts.select("_doc_id", "_doc_key", "drops", "n_boilerplate", "kept").distinct(), ["_doc_id", "_doc_key"])
    left = F.when(F.col("drops").isNull(), F.col("_doc_text")).otherwise(line_dedup.kept_text(F.col("_doc_text")))
    rows = joined.select("_doc_id", left.alias("left"), "n_boilerplate", "kept").distinct().collect()
    assert all(r["kept"] for r in rows) and len(rows) == 71
    for r in rows:
        if r["_doc_id"] in range(1, 70):
            assert r["left"] == f"\n{own(r['_doc_id'])}\nend {r['_doc_id']}" and r["n_boilerplate"] == 18
        elif r["_doc_id"] == 0:
            assert r["left"] == texts[0] and r["n_boilerplate"] == 0


def test_very_many_matches_in_one_text(spark):
    """Places and context at the end of a long text with 30,000 addresses, against a plain reading."""
    text = " ".join(f"a{i}@b{i % 97}.cd" + (" mail" if i % 7 == 0 else "") for i in range(30_000))
    frame = edges.frame(spark, [(1, text)])
    found = personal_data.personal_data(frame).first()["found"]
    spans = [(m.start(), m.end()) for m in re.finditer(brute.PLAIN["email"], text)]
    assert [(s["start"], s["end"]) for s in found] == spans and len(spans) == 30_000
    near = lambda a, b: re.search("mail|contact|write to|reach", text[max(a - 40, 0) : b + 40].lower())
    assert [s["score"] for s in found] == [0.9 if near(a, b) else 0.7 for a, b in spans]


def test_checksums(spark):
    row = spark.range(1).select(
        personal_data.luhn(F.lit("4111111111111111")).alias("a"), personal_data.luhn(F.lit("4111111111111112")).alias("b"),
        personal_data.mod97(F.lit("GB82 WEST 1234 5698 7654 32")).alias("c"),
        personal_data.mod97(F.lit("GB82 WEST 1234 5698 7654 33")).alias("d"),
    ).first()
    assert tuple(row) == (True, False, True, False)
