"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Kinds: email, ip (parts up to 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits) and iban (mod 97). Per kind,
matches are taken from the left and don't overlap; one that fails its check is dropped. Positions count code points.

The patterns are possessive and start only where a run of their characters starts (or where the last match ended), so
they find the same matches as their plain forms without going back, in time linear in the text.

Cases: a null or empty text has no spans; ids may be null or repeated, each row is judged alone; a text of any length is
read whole; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
# What each kind is made of.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9](?:[\x20().-]++[0-9]|[0-9][\x20().-]*+[0-9])(?:[\x20().-]*+[0-9])*+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
}
# A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}"}
SCORES = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8}
CONTEXT = {
    "email": "mail|contact|write to|reach",
    "ip": r"\bip\b|server|host|address|login",
    "card": "card|visa|credit|debit|payment|cvv",
    "phone": "phone|tel|call|mobile|fax|whatsapp",
    "iban": "iban|bank|account|transfer|konto",
}
AGAINST = r"example|sample|version|\bisbn\b|placeholder"
NEAR, MORE, LESS = 40, 0.2, 0.2


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            (2 * d.cast("int")) - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda total, x: total + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether letters and digits, the first four moved to the end and letters read as 10 to 35, leave 1 modulo 97."""
    plain = F.regexp_replace(code, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda r, c: (r * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97,
    )
    return rest == 1


def _confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        parts = F.split(hit, r"\.")
        return F.forall(parts, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    digits = _digits(hit)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return mod97(hit) if kind == "iban" else F.lit(True)


# Matches that are placed together, and characters of a text that are looked up together: a place is never sought from
# the beginning of a long text.
SLICE, CHUNK = 256, 4096


def _measured(kind: str) -> Column:
    """Every match with its length and that of the text before it."""
    return F.zip_with(
        f"_hits_{kind}", F.slice(f"_gaps_{kind}", F.lit(1), F.size(f"_hits_{kind}")),
        lambda h, g: F.struct(h.alias("hit"), F.length(g).alias("gap"), F.length(h).alias("n")),
    )


def _sliced(kind: str) -> Column:
    """The matches in slices, as an array only grows inside one slice."""
    each = F.col(f"_measured_{kind}")
    return F.when(F.size(each) > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(each) - 1) / SLICE).cast("int")), lambda k: F.slice(each, k * SLICE + 1, F.lit(SLICE))
    )).otherwise(F.array().cast("array<array<struct<hit:string,gap:int,n:int>>>"))


def _bases(kind: str) -> Column:
    """Where each slice begins in the text."""
    totals = F.transform(f"_slices_{kind}", lambda s: F.aggregate(s, F.lit(0), lambda at, x: at + x["gap"] + x["n"]))
    return F.aggregate(
        totals, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["found"], s["at"]).alias("found")),
        lambda s: s["found"],
    )


def _spans(kind: str) -> Column:
    """Start, end and text of every confirmed match, from the columns of matches and of the text between them."""
    nothing = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def walked(part: Column, base: Column) -> Column:
        return F.aggregate(
            part, F.struct(base.alias("at"), nothing.alias("found")),
            lambda s, x: F.struct((s["at"] + x["gap"] + x["n"]).alias("at"), F.array_append(s["found"], F.struct(
                (s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["n"]).alias("end"), x["hit"].alias("hit")
            )).alias("found")),
            lambda s: s["found"],
        )

    found = F.flatten(F.zip_with(f"_slices_{kind}", f"_bases_{kind}", walked))
    return F.filter(found, lambda s: _confirmed(kind, s["hit"]))


def _scored(kind: str) -> Column:
    def score(s: Column) -> Column:
        first, last = F.greatest(s["start"] - NEAR, F.lit(0)), s["end"] + NEAR
        chunk, end = F.floor(first / CHUNK).cast("int"), F.floor(last / CHUNK).cast("int")
        around = F.array_join(F.slice("_chunks", chunk + 1, end - chunk + 1), "")
        near = F.lower(F.substr(around, first - chunk * CHUNK + 1, last - first))
        return (
            F.lit(SCORES[kind])
            + F.when(near.rlike(CONTEXT[kind]), MORE).otherwise(0.0)
            - F.when(near.rlike(AGAINST), LESS).otherwise(0.0)
        )

    return F.transform(
        f"_spans_{kind}",
        lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(score(s), 2).alias("score")
        ),
    )


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and `found`, array of (kind, start, end, score) by kind as in KINDS, then start."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")
    )
    text = F.col("_text")
    nothing = F.array().cast("array<string>")
    for kind in KINDS:
        rows = rows.withColumn(f"_hits_{kind}", F.when(
            text.rlike(NEEDS[kind]), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(nothing))
    for kind in KINDS:
        rows = rows.withColumn(f"_gaps_{kind}", F.when(
            F.size(f"_hits_{kind}") > 0, F.split(text, PATTERNS[kind], -1)).otherwise(nothing))
    for column, made in (("measured", _measured), ("slices", _sliced), ("bases", _bases), ("spans", _spans)):
        rows = rows.withColumns({f"_{column}_{kind}": made(kind) for kind in KINDS})
    found = reduce(lambda a, b: a | b, [F.size(f"_spans_{kind}") > 0 for kind in KINDS])
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    rows = rows.withColumn("_chunks", F.when(found, chunks))
    return rows.select("doc_id", F.concat(*[_scored(kind) for kind in KINDS]).alias("found"))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
