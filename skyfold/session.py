"""Session helpers: a tuned local session and the shared folder used for checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SHUFFLES_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# Settings the operators rely on (zone) or profit from. The JVM does not compile methods of more than
# 8000 bytes of byte code, so wide projections run faster as several smaller generated methods.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Applies the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "skyfold", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master gets a folder of its own when the setting is missing: on a cluster a
    machine-local folder would be lost together with its executor, so that case is an error.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="skyfold-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)  # nobody else can read it later
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared folder, so lost executors cost nothing upstream."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for an intermediate table."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/skyfold-{spark.sparkContext.applicationId}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_stored(spark: SparkSession) -> None:
    """Removes every intermediate this application has written below the shared folder; call it when its results are safe."""
    drop_path(spark, _own_dir(spark))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends, not when the driver happens to collect its garbage: for large tables written one after the other."""
    before = spark.conf.get(SHUFFLES_KEY, None)
    spark.conf.set(SHUFFLES_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_KEY) if before is None else spark.conf.set(SHUFFLES_KEY, before)


def stored(df: DataFrame, name: str = "stored", parts: Sequence[str] = ()) -> DataFrame:
    """``df`` written as parquet below the shared folder and read back.

    The choice for wide tables that are read more than once: later scans read only the columns they
    need and know the size, which a checkpoint of whole rows does not offer. A filter on the columns ``parts`` reads only the folders of its values.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_measured(df: DataFrame, metrics: Mapping[str, Column], name: str = "stored") -> tuple[DataFrame, dict[str, Any]]:
    """``stored``, and aggregates over the written rows, all from one scan of the columns they need.

    Not observed in the writing job: a session that has held an ``Observation`` can no longer run forests' predictions (their
    closures reach the session, whose observation manager is not serialisable).
    """
    out = stored(df, name)
    return out, measured(out, metrics)


def measured(df: DataFrame, metrics: Mapping[str, Column]) -> dict[str, Any]:
    """Aggregates over a table by their names, from one scan."""
    return df.agg(*[c.alias(n) for n, c in metrics.items()]).first().asDict()


def stored_slices(parts: Iterable[DataFrame], name: str = "stored") -> DataFrame:
    """Parts of one table, written one after the other; what a part shuffles is on disk until it is written. A generator may work on a part only
    when its turn comes."""
    path = None
    for part in parts:
        spark, schema = part.sparkSession, part.schema
        path = path or scratch_path(spark, name)
        with shuffles_dropped(spark):
            part.write.mode("append").parquet(path)
    if path is None:
        raise ValueError("no parts given")
    return spark.read.schema(schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
