"""What queries need of their session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's executors, once a session: their Python need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='scoreforge-')}/scoreforge", "zip", root.parent, root.name)
    sc.addPyFile(made)
    _SHIPPED.add(sc.applicationId)


_SCRATCH: dict[str, tuple] = {}


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the folder that all executors share, ``spark.checkpoint.dir`` (a temporary one only where that is unset, as
    in tests); what is there when the program ends is deleted."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    shared = found.get() if found.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="scoreforge-"))
        shared = sc._jsc.sc().getCheckpointDir().get()
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared}/{what}-{uuid.uuid4().hex}")
    store = path.getFileSystem(sc._jsc.hadoopConfiguration())  # without a scheme: the cluster's default file system
    path = store.makeQualified(path)
    if not _SCRATCH:
        atexit.register(_clear)
    _SCRATCH[path.toString()] = store, path
    return path.toString()


def discard(path: str) -> None:
    """Deletes a folder of ``scratch`` that nothing reads any more."""
    store, found = _SCRATCH.pop(path)
    store.delete(found, True)


def _clear() -> None:
    for path in list(_SCRATCH):
        try:
            discard(path)
        except Exception:  # noqa: BLE001  the JVM may have ended before
            return


def size_of(df: DataFrame) -> int | None:
    """Bytes of what ``df`` reads, as Spark's optimizer estimates them (no job runs); None where it can't tell, which it says by exabytes."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 53 else None


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a fresh folder of ``scratch`` and read again: lineage is cut, and a lost executor costs no recompute."""
    path = scratch(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes one small file from the driver, in whatever store the path names."""
    sc = spark.sparkContext
    found = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = found.getFileSystem(sc._jsc.hadoopConfiguration()).create(found)
    out.write(bytearray(content))
    out.close()
