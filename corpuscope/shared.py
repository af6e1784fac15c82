"""Where intermediate tables go: only folders that every executor can reach.

``spark.checkpoint.dir`` names the shared folder of a cluster.  It is read from the session and
is only set here when it is unset, which is the case in tests and on a single machine.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
ROWS_A_FILE = 50_000
_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}
_block: ContextVar[list[str] | None] = ContextVar("block", default=None)


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; on a single machine, where the session need not name one, a temporary one."""
    uri = spark.conf.get(CHECKPOINT_DIR, None) or _own.get(spark.sparkContext.applicationId)
    if not uri:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="corpuscope-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        uri = _own[spark.sparkContext.applicationId] = f"file://{local}"
    return uri.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    if (block := _block.get()) is not None:
        block.append(path)
    return path


def drop_all(spark: SparkSession) -> int:
    """Delete every path this session made, once no frame that reads them is needed; how many there were."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        drop_path(spark, path)
    return len(paths)


def written(df: DataFrame, name: str, path: str | None = None, rows: int | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage.

    Unlike a local checkpoint, the files outlive any executor.  A frame of about so many narrow ``rows`` is written to a file for each
    ``ROWS_A_FILE``, if that is fewer than its partitions.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_A_FILE)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Delete what this block writes, but for some paths, at its end; what is kept belongs to the block around it."""
    outer, paths = _block.get(), []
    token = _block.set(paths)
    try:
        yield
    finally:
        _block.reset(token)
        every = _made.get(spark.sparkContext.applicationId, [])
        for path in paths:
            if path in keep:
                if outer is not None:
                    outer.append(path)
            elif path in every:
                every.remove(path)
                drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
