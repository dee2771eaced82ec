"""Readers and writers. Scans stay lazy so Catalyst can push filters and columns into them."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.session import shuffle_width


@dataclass(frozen=True)
class DataSize:
    """One of the supported data set sizes and the path suffix of its folders."""

    key: int | str
    suffix: str


# Size selector -> path suffix.
DATA_SIZES = {
    3: DataSize(3, "_3m"),
    6: DataSize(6, "_6m"),
    12: DataSize(12, "_1y"),
    "all": DataSize("all", ""),
}


def data_set(time: int | str) -> str:
    """Path suffix for a size selector; an unknown selector is an error, never a junk path."""
    try:
        return DATA_SIZES[time].suffix
    except KeyError:
        raise ValueError(f"unknown data set size {time!r}; use one of {list(DATA_SIZES)}") from None


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan; with a schema the footer of no file has to be read for planning."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV scan with a header and a stated schema (one pass, where inferring needs two)."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def literal_rows(spark: SparkSession, rows: Iterable[Sequence[Any]], schema: T.StructType | str) -> DataFrame:
    """A small hand-written table."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def write_table(
    df: DataFrame,
    path: str,
    n_files: int | None = None,
    keys: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """Parquet sink. ``n_files`` with ``keys`` lays rows out by key so later scans of a key touch few files.

    The layout is asked for as a rebalance, so adaptive execution splits the partition of a hot key
    and merges tiny ones instead of writing one huge file and many small ones.
    """
    if n_files:
        df = df.hint("rebalance", n_files, *keys) if keys else df.repartition(n_files)
    df.write.mode(mode).parquet(path)


def write_partitioned(df: DataFrame, path: str, partition_cols: Sequence[str]) -> None:
    """Hive-style sink: few files per partition value, a hot value split over several writers."""
    df.hint("rebalance", *partition_cols).write.mode("overwrite").partitionBy(*partition_cols).parquet(path)


def write_bucketed(
    df: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None, sort: Sequence[str] = (), laid_out: bool = False
) -> DataFrame:
    """Bucketed sink, and the table as it reads from there: joins, aggregates and windows on ``keys`` take it without an exchange.

    Buckets are as many as shuffle partitions unless stated, so that what is shuffled on the same keys meets the table bucket by bucket.
    ``laid_out`` says that ``df`` is hash-partitioned so already. All rows of a key are in one bucket: for keys that hold a large part
    of all rows use ``write_table``. The table is known to this session by its plan alone; its name is gone again.
    """
    spark, name = df.sparkSession, f"skyfold_{uuid.uuid4().hex}"
    n = buckets or shuffle_width(spark)
    rows = df if laid_out else df.repartition(n, *keys)
    rows.write.bucketBy(n, *keys).sortBy(*(sort or keys)).option("path", path).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def write_splits(train: DataFrame, test: DataFrame, path: str) -> None:
    """Both sides of a hold-out in one table, partitioned by ``split``."""
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    write_partitioned(both, path, ["split"])


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One side of a hold-out; the filter prunes to that side's directories."""
    return spark.read.parquet(path).filter(F.col("split") == split).drop("split")


def read_fold(spark: SparkSession, path: str, fold: int, role: str) -> DataFrame:
    """Rows of one fold in one role from a long ``fold``/``role`` table, by partition pruning."""
    return spark.read.parquet(path).filter((F.col("fold") == fold) & (F.col("role") == role))


def fold_ids(df: DataFrame, fold: str = "fold") -> DataFrame:
    """The folds present in a long fold table (its number is the number of rows returned)."""
    return df.select(fold).distinct()


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def append_metrics(spark: SparkSession, path: str, rows: Iterable[Mapping[str, Any]], schema: str) -> None:
    """Append run records (one small row per model run) to a metrics table."""
    names = T.StructType.fromDDL(schema).names
    spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema).coalesce(1).write.mode(
        "append"
    ).parquet(path)
