"""Intermediate tables in the folder that all executors share, and when they go again."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local = threading.local()
_lock = threading.Lock()
_own_folder: list[str] = []
#: What holds while a table is written: small Arrow batches, for whole texts and sets of hashes are large rows; and shuffle files go when the write ends.
#: The latter must not hold for other actions: iterators that fetch partitions one by one still need theirs.
_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
_writing: dict[int, list] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a local master gets a temporary folder; any other one raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    with _lock:
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="leafwright-"))
    return _own_folder[0]


@contextmanager
def _while_writing(spark: SparkSession) -> Iterator[None]:
    """The settings above while any thread of the session writes; the last one out restores what was there."""
    with _lock:
        held = _writing.setdefault(id(spark), [0, {}])
        if held[0] == 0:
            held[1] = {key: spark.conf.get(key, None) for key in _SETTINGS}
            for key, value in _SETTINGS.items():
                spark.conf.set(key, value)
        held[0] += 1
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if held[0] == 0:
                for key, value in held[1].items():
                    spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
                del _writing[id(spark)]


def materialised(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor costs only the tasks that read its blocks, external calls aren't repeated, and a later
    stage reads what an earlier one saw. Inside a ``scope`` the table goes when the scope ends, unless it is kept. Shuffle files
    behind it go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if getattr(_local, "scopes", None):
        _local.scopes[-1][path] = spark
    with _while_writing(spark):
        # No marker file: it would be one more file operation of the driver for each table, and nobody looks for it.
        df.write.option("compression", compression).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read any more."""
    for table in tables:
        path = table._written_path
        for own in getattr(_local, "scopes", []):
            own.pop(path, None)
        _remove(table.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Yields ``keep``. Tables written inside go when the block ends, but those passed to ``keep``, which the scope around takes over, if there is one."""
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    own: dict[str, SparkSession] = {}
    kept: set[str] = set()
    _local.scopes.append(own)

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._written_path)
        return table

    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _local.scopes.pop()
        for path, spark in own.items():
            if path not in kept:
                _remove(spark, path)
            elif _local.scopes:
                _local.scopes[-1][path] = spark
