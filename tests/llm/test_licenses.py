from __future__ import annotations

import re

import duckdb
import edges
import pytest

from keyvigil.llm import licenses
from keyvigil.llm.oracles import LLM_ORACLES

APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
ODD = [
    "Released under the MIT License.", "under the MIT licenses", "UNDER THE\nMIT---LICENSE under the mit license", "CC BY-NC 4.0", "cc by nc cc by nc",
    APACHE, "All rights reserved.", "all rights have been reserved", "This work is licensed under the GNU General Public License, version 3.",
    "licence text: gnu general public license version 33", "the apache license version 2é", "permission is hereby granted, free of charge",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including", "Licensed under CC BY-SA 4.0 and under the MIT License",
    "ünder the mit license", "under\x00the mit license", "a " * 3000 + APACHE, f"{APACHE} " * 200, "cc by nc " * 3000,
]


def plain(rows):
    """Labels by trying every template at every place of every file."""
    word = re.compile(licenses.WORD)
    files = [word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) for _, text in rows]
    known = set(licenses.vocabulary())
    held = [sorted(set(f) & known) for f in files]
    df = {w: sum(w in h for h in held) for w in known}
    results = []
    for (doc, _), words, own in zip(rows, files, held):
        def places(phrase, words=words):
            parts = phrase.split()
            return [i for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]

        found = sorted(x for phrase in licenses.BASE for x in places(phrase))
        base = {label for phrase, label in licenses.BASE.items() if places(phrase)}
        ranked = sorted(own, key=lambda w: (df[w], w))
        chosen = {w for k, w in enumerate(ranked) if k < licenses.TOP or df[w] * licenses.RARE <= len(files)}
        labels, share = set(base), 0.0
        for label, text, keys in licenses.TEMPLATES:
            template = text.split()
            if not all(places(k) for k in keys):
                continue
            starts = {p - at for k in keys for p in places(k) for at in range(len(template)) if template[at : at + len(k.split())] == k.split()}
            for start in starts:
                agree = sum(w in chosen and 0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(template))
                if agree >= licenses.least_places(len(template)):
                    labels.add(label)
                    share = max(share, agree / len(template))
        results.append((doc, len(words), len(found), found[0] if found else None, found[-1] if found else None, ",".join(sorted(base)),
                        ",".join(sorted(labels)), 1.0 if found else round(share, 6)))
    return results


def same(found, rows):
    assert sorted(repr(tuple(r)) for r in found) == sorted(map(repr, plain(rows)))


def test_odd_files(spark):
    rows = [*edges.texts(), *((100 + i, t) for i, t in enumerate(ODD)), (None, ODD[0]), (None, None), (100, ODD[0]), (3, APACHE)]
    same(licenses.licence_scan(edges.frame(spark, rows)).collect(), rows)


def test_notices_that_every_file_holds(spark):
    rows = [(i, f"file {i} {ODD[i % 4]} {APACHE} end {i}") for i in range(120)]
    found = licenses.licence_scan(edges.frame(spark, rows)).collect()
    same(found, rows)
    assert all("apache-2" in r["labels"] for r in found)


def test_given_documents_and_sql(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = licenses.licence_scan(docs).collect()
    same(found, rows)
    database = duckdb.connect()
    database.register("documents", docs.select("doc_id", "text").toPandas())
    answer = database.execute(LLM_ORACLES["op13_license_scan"]).fetchall()
    assert sorted(map(repr, answer)) == sorted(repr(tuple(r)) for r in found)


def test_no_rows(spark):
    assert licenses.licence_scan(edges.frame(spark, [], 1)).count() == 0


@pytest.mark.parametrize("template", licenses.TEMPLATES, ids=lambda t: t[0])
def test_templates_are_whole(template):
    _, text, keys = template
    assert keys and all(f" {key} " in f" {text} " for key in keys)
    assert text == " ".join(re.findall(licenses.WORD, text))
