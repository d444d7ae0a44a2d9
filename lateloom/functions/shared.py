"""Tables in the folder that driver and executors share: they cut lineage, and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset and all runs on one machine, as in tests, it is set to an own folder; on a cluster it must be set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = f"file://{tempfile.mkdtemp(prefix='lateloom-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/lateloom/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to a shared path and reads it back. The table stays until the session ends, or the temporary() around it."""
    path = shared_path(df.sparkSession)
    if not _written:
        atexit.register(forget)
    _written.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a table, as far as its session still lives; else its folder goes with the cluster's clean-up."""
    with contextlib.suppress(Exception):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget() -> None:
    """Deletes what materialize() has written and no temporary() has deleted."""
    while _written:
        _delete(*_written.pop())


@contextlib.contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written inside are deleted at the end. What is needed beyond goes through the function that this gives: a table that stays."""
    mark, stay = len(_written), []

    def result(df: DataFrame) -> DataFrame:
        out = materialize(df)
        stay.append(_written.pop())
        return out

    try:
        yield result
    finally:
        own = _written[mark:]
        _written[mark:] = stay
        for table in own:
            _delete(*table)


def tables() -> int:
    """How many tables there are that have not been deleted."""
    return len(_written)
