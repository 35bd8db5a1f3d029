"""What the operators share: the folder for materialised tables and cutting lineage.

Tables lie in the folder that ``spark.checkpoint.dir`` names and are removed when the driver's Python ends, or at the end
of a ``temporary`` block; a driver that is killed leaves them, under names that end in a random id.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: (session, path) of the tables that are to be removed.
_OWN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and driver and executors are one process, as in tests, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="larkspine-")
        shared_dir.own = found
        spark.sparkContext.setCheckpointDir(found)
    return found


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is removed in the end."""
    if not _OWN:
        atexit.register(_remove_since, 0)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _OWN.append((spark, path))
    return path


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: survives lost executors, has no lineage."""
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_since(n: int) -> None:
    for spark, path in reversed(_OWN[n:]):
        with contextlib.suppress(Exception):  # at the driver's end the session may be gone, and its folder with it
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _OWN[n:]


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Removes the tables that were written inside; what is to stay must be written outside, or read to its end."""
    n = len(_OWN)
    try:
        yield
    finally:
        _remove_since(n)
