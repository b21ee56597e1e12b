"""Tables written between steps, so that what follows never runs again what came before.

They go to the folder that the session names in spark.checkpoint.dir, which all machines share.  Where that is unset they
go to a temporary folder of this machine if the session runs on this machine alone, and are an error otherwise.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = _own.get(context.applicationId)
        if where is None:
            where = _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="gazetrail-")
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; `purge` deletes what was made so."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def mark() -> int:
    """A point in time, for `free`."""
    return len(_made)


def free(since: int, *keep: DataFrame) -> None:
    """Delete what was made after a mark, but for the tables of `keep`, which alone later plans read."""
    stay = {table._written_to for table in keep}
    for made in [m for m in _made[since:] if m[1] not in stay]:
        delete(*made)
        _made.remove(made)


def purge() -> None:
    """Delete every folder of this process; results that read them must be written before."""
    while _made:
        spark, path = _made.pop()
        delete(spark, path)


@atexit.register
def _at_exit() -> None:
    try:
        purge()
    except Exception:  # noqa: BLE001, S110 - the session is gone, its folder is the cluster's to clean
        pass
