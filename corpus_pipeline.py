"""From raw documents to packed training sequences: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents, whatever they are; rows are matched by
id and a fingerprint of the text, so null or repeated ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from keyvigil.llm import decontamination, line_dedup, near_dedup, packing, quality_rules
from keyvigil.llm.common import ID, KEY, LOWEST_ID, identified
from keyvigil.session import written


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({
        ID: F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST_ID)),
        KEY: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))),
    })


def _cut(joined: DataFrame, columns: list[str], n_chars_type: DataType | None) -> DataFrame:
    """The texts without the lines of the bitmap `drops`; n_chars follows where a text changed."""
    whole = F.col("drops").isNull()
    cut = joined.withColumn("text", F.when(whole, F.col("text")).otherwise(line_dedup.kept_text(F.col("text"))))
    if n_chars_type is not None:
        cut = cut.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(n_chars_type)))
    return cut.select(*columns)


def _n_chars_type(docs: DataFrame) -> DataType | None:
    return docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their boilerplate lines."""
    host = F.col("source").cast("string")
    keyed = _keyed(docs).withColumn(quality_rules.HOST, F.xxhash64(host.isNull(), F.coalesce(host, F.lit(""))))
    kept = quality_rules.verdicts(docs).where("kept").select(ID, KEY, quality_rules.HOST, "drops")
    # Repeated rows have one verdict.
    joined = keyed.join(kept.dropDuplicates([ID, KEY, quality_rules.HOST]), [ID, KEY, quality_rules.HOST])
    return _cut(joined, docs.columns, _n_chars_type(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds."""
    joined = _keyed(docs).join(line_dedup.keep_bitmaps(identified(docs)), [ID, KEY], "left")
    return _cut(joined, docs.columns, _n_chars_type(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    found = near_dedup.classes(identified(docs))
    stays = found.where("stays").select(ID, KEY)
    return _keyed(docs).join(stays, [ID, KEY], "left_semi").dropDuplicates([ID, KEY]).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontamination.matches(identified(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _keyed(docs).join(found.select(ID, KEY), [ID, KEY], "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place in it."""
    return packing.pack_documents(docs, keep_ids=False)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]

# A subword vocabulary and sampled signatures are beyond SQL: tests hold the stages against plain readings instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
