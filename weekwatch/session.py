"""Session helpers: the shared folder and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. A local session without the
    setting gets a fresh temporary folder; a cluster session without it is an
    error, because a machine-local folder would not survive a lost executor.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_folders[application]


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nobody has written to yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it once as a table in the shared folder and read that.

    Later readers prune columns, and a lost executor costs a re-read, not a recomputation.
    """
    path = new_path(df.sparkSession, "tabla")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once(spark: SparkSession, calls: Sequence[Callable[[], object]]) -> list:
    """Results of independent calls whose jobs run at the same time, in the order of the calls."""
    with ThreadPool(max(1, len(calls))) as pool:
        return pool.map(lambda call: call(), list(map(inheritable_thread_target(spark), calls)))
