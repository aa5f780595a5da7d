"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java form of a word: everything but space and the ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables.

    It is ``spark.checkpoint.dir``. Only a local master, which has one disk,
    may fall back to a temporary folder; a cluster without the setting is an
    error, as another executor could not read what one of them wrote.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="ravelin-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


_WORK: set[str] = set()


def work_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, below one folder of the application
    that goes when its Python process ends."""
    folder = f"{shared_dir(spark)}/ravelin-{spark.sparkContext.applicationId}"
    if folder not in _WORK:
        _WORK.add(folder)
        atexit.register(discard, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of written tables; nothing that reads them may be left."""
    _WORK.discard(folder)
    try:
        jvm = spark.sparkContext._jvm  # noqa: SLF001 - there is no public way to a file system
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001
    except Exception:  # noqa: BLE001 - the JVM has gone before: the folder stays, as without this
        return


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts
    lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that begins no column of ``df``, in any case."""
    while any(c.lower().startswith(name) for c in df.columns):
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(col: str = "text"):
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def vocabulary(name: str, folder: str | None = None) -> str:
    """The place of a public vocabulary file, found where the code runs."""
    folder = folder or os.environ.get("RAVELIN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
