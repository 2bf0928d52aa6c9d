"""Tables in the folder that the cluster shares, to cut lineage."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on a local master whose session names none.

    On a cluster each executor would write to a temporary folder of its own and rows would be lost, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='threadloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/threadloom/{tag}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)  # only what is there can be marked
    files.deleteOnExit(target)
    return f"{path}/t"


def written(df: DataFrame, tag: str = "t") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: executors may be lost, the rows stay.

    The table goes when the driver ends, or with ``forget``.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._threadloom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    path = getattr(df, "_threadloom_path", None)
    if path:
        path = path.removesuffix("/t")
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def _hadoop(spark: SparkSession, path: str):
    """File system and full name of a path, by the session's own settings."""
    raw = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = raw.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, files.makeQualified(raw)


def put_record(spark: SparkSession, path: str, value: object) -> None:
    """Writes a JSON record where the session's tables lie, under a name of its own first, so readers see the old or the new one."""
    files, target = _hadoop(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{target.toString()}.{uuid.uuid4().hex}.tmp")
    out = files.create(new, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    out.close()
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(new, target, options)


def get_record(spark: SparkSession, path: str) -> dict | None:
    """A JSON record of ``put_record``, or None if there is none."""
    files, target = _hadoop(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    files, target = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(target)) if files.exists(target) else []
