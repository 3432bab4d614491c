"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, nullcontext

from pyspark import SparkConf, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Types whose values are equal only if their bytes are.
_SAME_BYTES = (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def local_session(app: str = "attest", cores: str | None = None) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    if SparkSession.getActiveSession() is None and not SparkConf().contains(CHECKPOINT_DIR):
        # One machine: a folder of its own. A cluster names a shared one.
        spark = spark.config(CHECKPOINT_DIR, tempfile.mkdtemp(prefix="attest-"))
    spark = spark.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    ``local_session`` names one for a session on one machine; any other session must name one itself.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not named:
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    return named.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str, compression: str | None = None, remove_shuffles: bool = False) -> DataFrame:
    """Write a table to the shared folder once and read it back, so that several uses do not compute it again.

    ``compression`` names a codec of Parquet; ``zstd`` halves digests in hex, which the default leaves as they are.
    ``remove_shuffles`` frees the disk of the shuffles behind the table as soon as it is written.
    """
    path = fresh_folder(df.sparkSession, name)
    with shuffles_removed(df.sparkSession) if remove_shuffles else nullcontext():
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by_share(
    make: Callable[..., DataFrame],
    tables: Sequence[DataFrame],
    on: Sequence[str],
    shares: int,
    name: str,
    compression: str | None = None,
) -> DataFrame:
    """``make(*tables)`` as ``written`` leaves it, made one share of the keys ``on`` after the other.

    The result for a key must follow from the rows of that key alone. A share's shuffles are removed before the next one
    begins, so the disk holds those of one share only. The tables are computed again for each share, which must give the
    same rows. Keys that may be equal without having the same bytes (floating point, types that differ between the tables)
    are not dealt: all is one share.
    """
    spark = tables[0].sparkSession
    kinds = [[t.schema[c].dataType for c in on] for t in tables]
    exact = all(isinstance(k, _SAME_BYTES) or k == T.StringType() for k in kinds[0])
    if shares <= 1 or not exact or any(k != kinds[0] for k in kinds):
        return written(make(*tables), name, compression, remove_shuffles=True)
    folder = fresh_folder(spark, name)
    share = F.pmod(F.xxhash64(*on), F.lit(shares))
    parts = [f"{folder}/{i}" for i in range(shares)]
    with shuffles_removed(spark):
        for i, part in enumerate(parts):
            made = make(*[t.where(share == i) for t in tables])
            made.write.parquet(part, compression=compression)
    return spark.read.schema(made.schema).parquet(*parts)


def ship_with_plans(module: str) -> None:
    """Send a module's task functions inside the plan, so that workers need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
