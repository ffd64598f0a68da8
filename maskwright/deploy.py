"""What every job needs of a cluster: the package on its workers, and written stages in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes that one row group of Parquet holds by default: what one task reads.
ROW_GROUP = 128 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's modules to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        here = Path(__file__).parent
        folder = tempfile.TemporaryDirectory(prefix="maskwright-")
        weakref.finalize(sc, folder.cleanup)
        path = Path(folder.name) / "maskwright.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(str(path))
        _SHIPPED.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named: one beside the warehouse in local mode, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
    return named.rstrip("/")


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Has Spark remove the shuffle files of an action when it ends; the session's own setting comes back afterwards."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


class Stages:
    """Tables written between the steps of a job: computed once, cheap to read again when an executor is lost.

    Used as a context, all tables go when it ends, so what reads them has to be written by then. Otherwise
    they go when the application ends; drop() deletes those that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str = "stages"):
        self.spark, self.root, self.n = ship(spark), f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        _KEPT.append(self)

    def write(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        with tidy_shuffles(self.spark):
            df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._stage_path)

    def close(self) -> None:
        if self in _KEPT:
            _KEPT.remove(self)
            self._delete(self.root)

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_) -> None:
        self.close()


_KEPT: list[Stages] = []


@atexit.register
def _close_all() -> None:
    for stages in list(_KEPT):
        try:
            stages.close()
        except Exception:  # noqa: BLE001  # the JVM has ended before
            return


def input_bytes(df: DataFrame) -> int:
    """The size of what a frame reads, by the optimizer's estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores, if the input is too small to fill them with row groups of their own; else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if input_bytes(df) < cores * ROW_GROUP else df
