"""Session helpers: table reading, shared workspace, lineage cuts, size-checked broadcasts, shipping code."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    ship(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else f"file://{tempfile.gettempdir()}/skald-checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/skald-{name}-{uuid.uuid4().hex}"
    atexit.register(_quiet_delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    hadoop_fs(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def _quiet_delete(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the JVM may be gone already
        pass


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder (reliable checkpoint), so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def hadoop_fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def write_text_atomically(spark: SparkSession, path: str, text: str) -> None:
    """Readers see nothing or all of it, and of two writers one fails: through the session's checkpoint file manager, which knows the atomic way of each
    file system (a rename that doesn't overwrite, or an upload that appears when it is closed)."""
    jvm = spark._jvm
    managers = jvm.org.apache.spark.sql.execution.streaming
    manager = managers.checkpointing.CheckpointFileManager
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = manager.create(target.getParent(), spark._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    if files.exists(target):
        raise RuntimeError(f"{path} was committed by another writer")
    out = files.createAtomic(target, False)
    try:
        out.write(bytearray(text.encode()))
        out.close()
    except Exception as e:
        out.cancel()
        raise RuntimeError(f"{path} was committed by another writer") from e


def read_text(spark: SparkSession, path: str) -> str:
    fs, Path = hadoop_fs(spark, path), spark._jvm.org.apache.hadoop.fs.Path
    stream = fs.open(Path(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = hadoop_fs(spark, path), spark._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def small_or_none(df: DataFrame, max_rows: int) -> list | None:
    """The rows, if there are at most max_rows of them; None beyond, without having fetched more than one extra row."""
    rows = df.limit(max_rows + 1).collect()
    return None if len(rows) > max_rows else rows


def spread(df: DataFrame) -> DataFrame:
    """Use the cores where the input came as few splits (few or single row groups): with less than one for two cores, a shuffle of the rows pays."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if 2 * df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Give executors the package, where they don't share the driver's file system paths."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp()  # on the driver, which hands the file to the executors
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "skald.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join("skald", os.path.relpath(full, root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def code_points(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def blank(column):
    """Null, or nothing but white space; the no-break and other Unicode spaces count as white space."""
    return F.coalesce(F.regexp_replace(column, r"[\s\u0085\p{Z}\u001c-\u001f]+", "") == "", F.lit(True))
