"""Small tables with every odd case, made for the tests."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("marks", T.StringType()), T.StructField("block", T.StringType()), T.StructField("length", T.StringType()),
])


def sentence(rng: random.Random, words: int, start: int = 0) -> str:
    return " ".join(rng.choice("alpha beta gamma delta épsilon zeta eta theta iota kappa".split()) + str(rng.randrange(200))
                    for _ in range(words))


def texts() -> list[tuple[int, str | None]]:
    """Unique ids; null, empty, white, repeated, overlapping and long texts."""
    rng = random.Random(5)
    shared, other = sentence(rng, 60), sentence(rng, 45)
    line = "A line that comes back in many documents."
    made = [
        None, "", " \t\n", "one", "\n\n", "a\nb", shared, shared, f"{sentence(rng, 20)} {shared} {sentence(rng, 9)}",
        f"{other}\n{other}", sentence(rng, 4000), f"{line}\nown {sentence(rng, 30)}\n{line}", f"  {line.upper()}\t\nx {sentence(rng, 8)}",
        f"{line}\r\n{other}", "spam egg " * 300, "spam egg " * 150, "ü" * 500, "x" * 1200, "x" * 900,
        "mail a.b@c.example.org, a@b.c_d@e.f then +49 (0)30 1234-5678 and 4111 1111 1111 1111, 10.0.0.1 1.2.3.4.5.6.7.8 999.1.1.1 "
        "IBAN DE89 3704 0044 0532 0130 00 ok", "0" * 3000 + " +1 22", "a" * 3000 + "@", "+1((((", "\U0001f600 a@b.cd \U0001f600 +123456789",
        other[: len(other) // 2] + " tail", "\x0b\x0c word\x1cword\x85word\xa0word",
    ]
    return list(enumerate(made))


def frame(spark, rows, partitions: int = 3):
    """As a documents table with further columns of clashing names."""
    full = [(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 4 else None, None if t is None else len(t), "x", "y", "z") for i, t in rows]
    return spark.createDataFrame(full, DOCUMENTS).repartition(partitions)
