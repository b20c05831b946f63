"""Tables in the folder that a cluster shares: where lineage is cut, and how what was written is deleted again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Where that isn't set, a local master, whose
    executors are this process, gets a folder of its own, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="siftwork-")
            atexit.register(shutil.rmtree, _own[context.applicationId], True)
        found = _own[context.applicationId]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    return path


def cut(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later jobs start from files that outlive any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftwork_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _tables:
        _tables.remove(path)


def mark() -> int:
    """How many tables of cut() and folders of new_path() there are, for sweep()."""
    return len(_tables)


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete what was written since mark() but the tables to keep, once what read it has been written itself."""
    kept = {getattr(df, "_siftwork_path", None) for df in keep}
    for path in _tables[since:]:
        if path not in kept:
            _delete(spark, path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_siftwork_path", None)
        if path:
            _delete(df.sparkSession, path)
