"""Reading and writing tables: explicit schemas, Parquet or CSV, partitioned by replica and condition."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyvigil.functions.text import split_cell
from keyvigil.schemas import MULTIVALUE_SEPARATOR, TABLES

GRID = ("seed", "sigma")
CSV_OPTIONS = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}
GRID_TYPES = {"seed": T.IntegerType(), "sigma": T.DoubleType()}


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def missing_tables(spark: SparkSession, root: str, names: Sequence[str], layout: str = "parquet") -> list[str]:
    return [name for name in names if not _exists(spark, table_path(root, name, layout))]


def table_path(root: str, name: str, layout: str = "parquet") -> str:
    return f"{root.rstrip('/')}/{name}.{layout}"


def _schema(name: str, partitioned_by: Sequence[str]) -> T.StructType:
    known = TABLES[name]
    extra = [T.StructField(key, GRID_TYPES[key]) for key in partitioned_by if key not in known.names]
    return T.StructType(known.fields + extra)


def read_table(
    spark: SparkSession, root: str, name: str, layout: str = "parquet", partitioned_by: Sequence[str] = ()
) -> DataFrame:
    """A table by name with its declared schema. A missing one is named in the error.

    With `partitioned_by`, all runs are one read and a filter on `seed` or `sigma` reads only their folders.
    """
    if missing_tables(spark, root, [name], layout):
        raise FileNotFoundError(f"table {name!r} is missing under {root}")
    schema = _schema(name, partitioned_by)
    path = table_path(root, name, layout)
    if layout == "parquet":
        return spark.read.schema(schema).parquet(path)
    if layout != "csv":
        raise ValueError(f"unknown layout {layout!r}, expected 'parquet' or 'csv'")
    as_text = T.StructType(
        [T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in schema]
    )
    rows = spark.read.schema(as_text).options(**CSV_OPTIONS).csv(path)
    lists = {f.name for f in schema if isinstance(f.dataType, T.ArrayType)}
    return rows.select(
        *[split_cell(F.col(f.name)).alias(f.name) if f.name in lists else F.col(f.name) for f in schema]
    )


def read_all(spark: SparkSession, root: str, names: Sequence[str], layout: str = "parquet") -> dict[str, DataFrame]:
    absent = missing_tables(spark, root, names, layout)
    if absent:
        raise FileNotFoundError(f"tables missing under {root}: {', '.join(absent)}")
    return {name: read_table(spark, root, name, layout) for name in names}


def write_table(
    frame: DataFrame,
    root: str,
    name: str,
    layout: str = "parquet",
    partitioned_by: Sequence[str] = (),
    mode: str = "errorifexists",
    only_own: bool = False,
) -> str:
    """Header and LF in CSV, arrays as one multi-value cell; the folder is created.

    With `mode="overwrite"` and `only_own`, only the partitions that the frame has rows of are replaced.
    """
    path = table_path(root, name, layout)
    if layout == "csv":
        cells = [
            F.array_join(F.col(f.name), MULTIVALUE_SEPARATOR).alias(f.name)
            if isinstance(f.dataType, T.ArrayType)
            else F.col(f.name)
            for f in frame.schema
        ]
        frame = frame.select(*cells)
    if partitioned_by:
        # Rows of one run meet before the write; the adaptive planner cuts a large run and merges small ones.
        frame = frame.hint("rebalance", *partitioned_by)
    writer = frame.write.mode(mode)
    if partitioned_by:
        writer = writer.partitionBy(*partitioned_by)
    if only_own:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if layout == "csv":
        writer.options(**CSV_OPTIONS).csv(path, lineSep="\n")
    else:
        writer.parquet(path)
    return path


def _commits(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.commits"


def committed_runs(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Runs of a table whose last writing attempt ended, with the number of that attempt. One row per run of the grid."""
    if not _exists(spark, _commits(root, name)):
        return spark.createDataFrame([], "seed int, sigma double, attempt bigint")
    log = spark.read.schema("seed int, sigma double, attempt bigint, done boolean").parquet(_commits(root, name))
    # Of one attempt, the row of its end is the larger one.
    last = log.groupBy(*GRID).agg(F.max(F.struct("attempt", "done")).alias("_last"))
    return last.where("_last.done").select(*GRID, F.col("_last.attempt").alias("attempt"))


def write_runs(frame: DataFrame, root: str, name: str, layout: str = "parquet") -> str:
    """Write, or write again, the runs that the frame has rows of. All other runs stay as they are.

    The runs are noted in a commit list before and after, so a run whose job was killed half way is not in
    `committed_runs`, `uncommitted_runs` names it, and writing it once more replaces what it left behind. One writer at a time.
    """
    spark = frame.sparkSession
    path = _commits(root, name)
    runs = frame.select(*[F.col(key).cast(GRID_TYPES[key]).alias(key) for key in GRID]).distinct().collect()  # the grid
    if not runs:
        return table_path(root, name, layout)
    before = spark.read.parquet(path).agg(F.max("attempt")).first()[0] if _exists(spark, path) else 0

    def note(done: bool) -> None:
        rows = [(run["seed"], run["sigma"], before + 1, done) for run in runs]
        listed = spark.createDataFrame(rows, "seed int, sigma double, attempt bigint, done boolean")
        listed.coalesce(1).write.mode("append").parquet(path)

    note(False)
    target = write_table(frame, root, name, layout, GRID, "overwrite", only_own=True)
    note(True)
    return target


def uncommitted_runs(spark: SparkSession, root: str, name: str, seeds: Sequence[int], sigmas: Sequence[float]) -> DataFrame:
    """Expected runs that were never written or whose last attempt did not end."""
    return missing_runs(committed_runs(spark, root, name), seeds, sigmas)


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table whose cells all stay text: "None" and "2" are read as written, nothing is guessed."""
    return spark.read.options(**CSV_OPTIONS).csv(path)


def of_run(table: DataFrame, seed: int, sigma: float) -> DataFrame:
    """The rows of one run without the grid columns."""
    return table.where((F.col("seed") == seed) & (F.col("sigma") == sigma)).drop(*GRID)


def of_condition(metrics: DataFrame, sigma: float, scope: str) -> DataFrame:
    return metrics.where((F.col("sigma") == sigma) & (F.col("scope") == scope))


def of_mechanisms(table: DataFrame, mechanisms: Sequence[str]) -> DataFrame:
    return table.where(F.col("mechanism").isin(*mechanisms))


def pooled(predictions: DataFrame, sigma: float) -> DataFrame:
    """Predictions of all replicas at one condition."""
    return predictions.where(F.col("sigma") == sigma)


def runs_index(runs: Sequence[DataFrame]) -> DataFrame:
    """All run rows, ordered by replica and condition. One row per run of the grid."""
    return reduce(DataFrame.unionByName, runs).orderBy(*GRID)


def thresholds_of_seeds(thresholds: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Thresholds of the wanted replicas; one that has not run is left out, none at all is an error."""
    found = thresholds.where(F.col("seed").isin(*seeds))
    if not found.take(1):
        raise FileNotFoundError(f"no thresholds for any of the seeds {list(seeds)}")
    return found


def missing_runs(present: DataFrame, seeds: Sequence[int], sigmas: Sequence[float]) -> DataFrame:
    """Expected runs of the grid that are absent."""
    spark = present.sparkSession
    expected = spark.range(1).select(
        F.explode(F.array(*[F.lit(seed).cast("bigint") for seed in seeds])).alias("seed"),
    ).select("seed", F.explode(F.array(*[F.lit(float(sigma)) for sigma in sigmas])).alias("sigma"))
    return expected.join(present.select(*GRID).distinct(), list(GRID), "left_anti")


def filtered(table: DataFrame, operator_id: str | None = None, expression: str = "") -> tuple[DataFrame, str | None]:
    """One operator and one free expression. A wrong expression is a warning, and the table stays as it was."""
    kept = table if operator_id is None else table.where(F.col("operator_id") == operator_id)
    if not expression.strip():
        return kept, None
    try:
        narrowed = kept.where(F.expr(expression))
        narrowed.schema  # resolved here, so a wrong name shows before any job starts
        return narrowed, None
    except (AnalysisException, ParseException) as wrong:
        return kept, f"invalid expression: {wrong}"


def kept_share(table: DataFrame, expression: str) -> DataFrame:
    """Rows a filter keeps, all rows, and the share, in one pass."""
    kept = F.count_if(F.expr(expression))
    return table.agg(
        kept.alias("kept"), F.count("*").alias("total"), F.try_divide(kept.cast("double"), F.count("*")).alias("share")
    )
