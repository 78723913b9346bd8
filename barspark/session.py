"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "barspark") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.executorEnv.PYTHONPATH", str(Path(__file__).resolve().parents[1]))  # workers import the package from any folder
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go when their job ends: for jobs whose result is stored."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Where neither is set, a local master (tests, laptop runs) gets a temporary one; on a cluster, whose machines
    would not see it, that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.checkpoint(eager)


_STORED: dict[tuple[str, str], str] = {}


def stored(df_of, spark: SparkSession, name: str) -> DataFrame:
    """Write ``df_of()`` once per application to the shared folder and read it back.

    A bar table is built once and read by everything after it, with column
    pruning, pushdown and known sizes.
    """
    sc = spark.sparkContext
    key = (sc.applicationId, name)
    if key not in _STORED:
        path = f"{shared_folder(spark)}/barspark-{sc.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        with shuffles_removed(spark):
            df_of().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])
