"""Licence notices by a positional index of rare words.

Every template is the wording of a notice with one or more mandatory key phrases. Of each file,

1. the licence words (those of any template) it holds are ranked by inverse document frequency over all files; looked up are
   its `TOP` rarest ones and all that at most one file in `RARE` holds;
2. each looked-up place meets the template postings of its word: (template, relative position) with how many places agree
   there, so a notice is one entry however common its single words are;
3. an entry that `least_places` looked-up words agree on is verified: one of the template's key phrases stands exactly at
   its place in the notice, and all of them are in the file.

The score is the largest share of a verified template's words found in place; a base phrase counts as 1.

DataFrame functions only. The words of a file are read in one row and never exploded; of files without any key phrase only
the distinct licence words (bounded by the templates) are kept, for the counts. Shuffled are counts per licence word and,
of files with a key phrase, places of looked-up words, by file, template and relative position.

Cases: null and empty texts have no words, no labels and null places; ids may be null or repeated, each row is judged alone
under a row number of its own; texts of any length are read whole; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyvigil.llm.common import ascii_lower
from keyvigil.session import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOP, RARE, LEAST_PLACES = 8, 20, 3
# Phrases that decide by themselves, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Label, wording of the notice, and its mandatory key phrases, as words.
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("mit", "released under the mit license", ("the mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction",
     ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
     "with the license", ("apache license version 2",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", ("redistribution and use in source and binary forms", "are permitted provided that")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", ("permission to use copy modify and or distribute this software",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
     "free software foundation", ("under the terms of the gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license v 2",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights",
     ("waived all copyright and related",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution 4 0",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license",
     ("creative commons attribution sharealike",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license",
     ("creative commons attribution noncommercial",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
]


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text, keys in templates for w in " ".join((text, *keys)).split()} | {w for p in BASE for w in p.split()})


def phrases(templates=TEMPLATES) -> list[str]:
    """The base phrases, then all other key phrases."""
    return [*BASE, *sorted({key for _, _, keys in templates for key in keys} - set(BASE))]


def least_places(words: int) -> int:
    return min(LEAST_PLACES, words)


def postings(templates=TEMPLATES) -> list[tuple[str, int, int]]:
    """(word, template, position) of every word of every template."""
    return [(word, k, place) for k, (_, text, _) in enumerate(templates) for place, word in enumerate(text.split())]


def key_places(templates=TEMPLATES) -> list[tuple[int, int, int]]:
    """(template, number of the key phrase, its position in the template)."""
    numbers = {phrase: k for k, phrase in enumerate(phrases(templates))}
    found = []
    for k, (_, text, keys) in enumerate(templates):
        for key in keys:
            words, whole = key.split(), text.split()
            found += [(k, numbers[key], at) for at in range(len(whole)) if whole[at : at + len(words)] == words]
    return found


def _occurrences(number: int, phrase: str) -> Column:
    """(phrase, place) wherever the words of the phrase stand consecutively, from the places of licence words."""
    def stands(j: Column) -> Column:
        first = F.get("hits", j)
        each = [F.get("hits", j + t)["word"].eqNullSafe(F.lit(w)) & F.get("hits", j + t)["at"].eqNullSafe(first["at"] + t)
                for t, w in enumerate(phrase.split())]
        return reduce(lambda a, b: a & b, each)

    places = F.filter(F.sequence(F.lit(0), F.size("hits") - 1), stands)
    found = F.transform(places, lambda j: F.struct(F.lit(number).alias("phrase"), F.get("hits", j)["at"].alias("at")))
    return F.when(F.contains("joined", F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<struct<phrase:int,at:int>>"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """Per row, stored: row, doc_id, n_words, its distinct licence words, its key phrases with their places and, if it has any, the
    places of all its licence words."""
    known = vocabulary(templates)
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    rows = rows.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    any_key = reduce(lambda a, b: a | b, [F.contains("joined", F.lit(f" {p} ")) for p in phrases(templates)])
    all_words = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    hits = F.when(any_key, F.filter(all_words, lambda h: h["word"].isin(known))).otherwise(
        F.array().cast("array<struct<at:int,word:string>>"))
    rows = rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), "joined",
        F.array_intersect("words", F.array(*map(F.lit, known))).alias("licence_words"), hits.alias("hits"),
    )
    keys = F.concat(*[_occurrences(k, p) for k, p in enumerate(phrases(templates))])
    found = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "licence_words", "hits", keys.alias("keys"))
    return written(found, "licence-words")


def notices(scan: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Verified notices: row, template, start (relative position 0 in the file), places (how many words agree there)."""
    spark = scan.sparkSession
    counts = scan.select(F.explode("licence_words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    # One row, and at most as many entries as the templates have words.
    frequency = counts.agg(F.map_from_entries(F.collect_list(F.struct("word", "df")))).scalar()
    files = scan.agg(F.count("*")).scalar()
    ranked = F.array_sort(F.transform("licence_words", lambda w: F.struct(F.col("_df")[w].alias("df"), w.alias("word"))))
    chosen = F.filter(ranked, lambda x, i: (i < TOP) | (x["df"] * RARE <= F.col("_files")))
    held = scan.where(F.size("keys") > 0).withColumns({"_df": frequency, "_files": files})
    held = held.withColumn("_chosen", F.transform(chosen, lambda x: x["word"]))
    looked_up = held.select(
        "row", F.inline(F.filter("hits", lambda h: F.array_contains("_chosen", h["word"])))
    )
    index = F.broadcast(spark.createDataFrame(postings(templates), "word string, template int, place int"))
    entries = looked_up.join(index, "word").groupBy("row", "template", (F.col("at") - F.col("place")).alias("start")).agg(
        F.count("*").alias("places")
    )
    sizes = F.array(*[F.lit(least_places(len(text.split()))) for _, text, _ in templates])
    entries = entries.where(F.col("places") >= F.get(sizes, F.col("template")))
    expected = F.broadcast(spark.createDataFrame(key_places(templates), "template int, phrase int, place int"))
    placed = entries.join(expected, "template").withColumn("at", F.col("start") + F.col("place"))
    standing = scan.select("row", F.inline("keys"))
    # All key phrases of the template are somewhere in the file ...
    numbers = {phrase: k for k, phrase in enumerate(phrases(templates))}
    needed = F.array(*[F.array(*[F.lit(numbers[key]) for key in keys]) for _, _, keys in templates])
    present = scan.where(F.size("keys") > 0).select("row", F.array_distinct(F.transform("keys", lambda k: k["phrase"])).alias("_held"))
    # ... and one stands at its place in the notice.
    aligned = placed.join(standing, ["row", "phrase", "at"], "left_semi").groupBy("row", "template", "start").agg(
        F.max("places").alias("places")
    )
    whole = aligned.join(present, "row").where(F.size(F.array_except(F.get(needed, F.col("template")), F.col("_held"))) == 0)
    return whole.select("row", "template", "start", "places")


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    scan = scanned(docs, id_col, text_col, templates)
    label = F.array(*[F.lit(name) for name, _, _ in templates])
    share = F.col("places") / F.get(F.array(*[F.lit(len(text.split())) for _, text, _ in templates]), F.col("template"))
    of_row = notices(scan, templates).groupBy("row").agg(
        F.collect_set(F.get(label, F.col("template"))).alias("_labels"), F.max(share).alias("_share")
    )
    base = F.filter("keys", lambda k: k["phrase"] < len(BASE))
    starts = F.transform(base, lambda k: k["at"])
    names = F.array(*[F.lit(name) for name in BASE.values()])
    own = F.array_distinct(F.transform(base, lambda k: F.get(names, k["phrase"])))
    nothing = F.array().cast("array<string>")
    joined = scan.select(
        "row", "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), own.alias("_own"),
    ).join(of_row, "row", "left")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_own"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_own", F.coalesce("_labels", nothing))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.round(F.coalesce("_share", F.lit(0.0)), 6)).alias("score"),
    )
