"""Tables in the folder that the driver and all executors share, and their removal."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class _Written(threading.local):
    """The paths that this thread has had; runs in other threads have their own."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_WRITTEN = _Written()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where it is unset (local tests), a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses; `forget` removes what lies there."""
    path = f"{shared_folder(spark)}/pagewright-{uuid.uuid4().hex}"
    _WRITTEN.paths.append(path)
    return path


def shared_table(df: DataFrame) -> DataFrame:
    """Written once to the shared folder, and read back: cuts the lineage, and survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def mark() -> int:
    """The present moment of this thread, for `forget`."""
    return len(_WRITTEN.paths)


def forget(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Remove what this thread wrote since a mark, but for the files that `keep` reads. Frames that read the rest can't be used any more."""
    kept = {f.rsplit("/", 1)[0] for f in keep.inputFiles()} if keep is not None else set()
    left = []
    for path in _WRITTEN.paths[since:]:
        if any(k.endswith(path.rsplit("/", 1)[1]) for k in kept):
            left.append(path)
        else:
            remove(spark, path)
    _WRITTEN.paths[since:] = left


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder inside is removed on leaving; results must have been written elsewhere by then."""
    since = mark()
    try:
        yield
    finally:
        forget(spark, since)
