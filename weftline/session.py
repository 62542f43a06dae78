"""Session helpers: a local session for tests and the checkpoint folder rule."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weftline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


#: Folder of this process's local sessions where none is set; saved tables of each application, to be removed at its end.
_local_folder: str | None = None
_saved: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set (local tests)."""
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


def _remove_saved() -> None:
    for folder, spark in list(_saved.items()):
        try:
            _remove(spark, folder)
        except Exception:  # the engine is gone already; what is left is the folder's owner's
            pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once to the shared folder and read again.

    Cuts the lineage like a checkpoint, but columnar and compressed, and later
    readers prune columns. Files survive the loss of executors. They are removed
    when the process ends, or by ``discard``.

    The size the optimizer sees is that of compressed files, so it would take a
    large table for one that can be broadcast: the table asks for merge joins.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/weftline-{spark.sparkContext.applicationId}"
    if not _saved:
        atexit.register(_remove_saved)
    _saved[folder] = spark
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path).hint("merge")
    out._weftline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a table from ``written`` that nothing will read any more."""
    path = getattr(df, "_weftline_path", None)
    if path:
        _remove(df.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors, once per application.

    Spark's file server hands the archive out, so executors need no path of
    their own; one that is replaced fetches it again.
    """
    sc = spark.sparkContext
    if getattr(sc, "_weftline_shipped", None) == sc.applicationId:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    whole = os.path.join(at, f)
                    z.write(whole, os.path.join("weftline", os.path.relpath(whole, home)))
    folder = f"{shared_folder(spark).rstrip('/')}/weftline-{sc.applicationId}"
    if not _saved:
        atexit.register(_remove_saved)
    _saved[folder] = spark
    path = f"{folder}/weftline-{uuid.uuid4().hex}.zip"
    jvm = sc._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).create(target)
    stream.write(packed.getvalue())
    stream.close()
    sc.addPyFile(path)
    sc._weftline_shipped = sc.applicationId
