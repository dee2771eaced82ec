"""What the operators of this subpackage share: word rules, hot-safe keys, and shipping the package to executors."""

from __future__ import annotations

import ctypes
import functools
import pathlib
import sys
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable on executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parents[1]
    archive = pathlib.Path(tempfile.mkdtemp(prefix="skyfold-code-")) / "skyfold_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def give_back() -> None:
    """Returns freed memory to the system. Workers are kept for the next task, and what they hold counts beside their executor's heap."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def lean(read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``read``, a function for ``mapInArrow``, that gives its memory back when its task is over."""

    @functools.wraps(read)
    def run(batches):
        yield from read(batches)
        give_back()

    return run


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col), F.lit(""))


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(WORD)).cast("long")


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def packed(docs: DataFrame, *derived: Column) -> DataFrame:
    """All columns of ``docs`` in one struct ``_row``, beside derived ones: no name of an input column can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), *derived)
