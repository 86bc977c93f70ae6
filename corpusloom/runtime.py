"""Reading tables, and cutting lineage in storage that outlives an executor."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_STAGED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The test table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` where it is set.

    Where it is unset and everything runs on one machine (tests, notebooks) a temporary folder is used. On a
    cluster that would leave every executor's part on its own disk, so there an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    return _LOCAL[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; the folder is then left to its owner
        pass


def _release(kept: int) -> None:
    while len(_STAGED) > kept:
        _remove(*_STAGED.pop())


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Intermediate tables written inside are removed at the end, when their results have been consumed."""
    kept = len(_STAGED)
    try:
        yield
    finally:
        _release(kept)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike a cached or locally checkpointed frame, the table survives the loss of any executor, is
    columnar (later readers prune columns) and gives the planner true sizes. It is removed at the end of the
    process, or of the ``released`` block it was written in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _STAGED:
        atexit.unregister(_release)
        atexit.register(_release, 0)
    _STAGED.append((spark, path))
    return spark.read.parquet(path)
