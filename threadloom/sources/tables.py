"""Readers: thread and text CSV, Parquet tables, JSON records, file listings; and thread rows from conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.text import norm_text
from threadloom.operators.ordinal import with_ordinal
from threadloom.sources.store import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 CSV with header, all strings: quoted line ends, doubled quotes, short and long rows as usual."""
    opts = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "encoding": "UTF-8", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "maxCharsPerColumn": 128 << 20, "inferSchema": False}
    return spark.read.options(**opts).csv(path)


def with_file_order(df: DataFrame) -> DataFrame:
    """Adds ``_rowidx``, the 0-based position in file order: row counts of the partitions before, then the place inside.

    Reading splits are deterministic, so both passes see the same partitions.
    """
    tagged = df.withColumns({"_p": F.spark_partition_id(), "_k": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = tagged.groupBy(F.col("_p").alias("p")).agg(F.count("*").alias("n")).select("p", F.coalesce(before, F.lit(0)).alias("start"))
    return tagged.join(F.broadcast(sizes), F.col("_p") == F.col("p")).withColumn("_rowidx", (F.col("start") + F.col("_k")).cast("long")).drop("_p", "_k", "p", "start")


def column_scan(df: DataFrame, column: str = "text") -> DataFrame:
    """Stripped, non-blank values of one column."""
    return df.select(norm_text(F.col(column)).alias("text")).where("text != ''")


def has_column(df: DataFrame, column: str) -> bool:
    return column in df.columns


def is_threaded(df: DataFrame, mode: str) -> bool:
    """Whether a table is read as threads: a chat mode, and the columns it needs."""
    return mode in ("chat", "dialogplus") and {"id", "Assistentin"} <= set(df.columns)


def read_json(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """JSON records of a fixed schema; broken ones are dropped, missing fields get their defaults."""
    got = spark.read.schema(f"{schema}, _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    got = written(got, "json")  # a reader can't be asked for its broken records alone
    ok = got.where("_broken is null").drop("_broken")
    return ok.fillna(defaults) if defaults else ok


def list_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``path, mtime, size`` of the files below a folder, by name; the suffix is compared without case."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return got.where(F.lower("path").like(f"%{suffix.lower()}")).orderBy("path")


def thread_rows(conversations: DataFrame) -> DataFrame:
    """Thread rows of conversation turns: each user turn opens a row, the assistant turn after it fills the answer.

    ``id`` is ``conv_id * 1000 + n``; the parent is the row before; a system turn belongs to the first row.
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = conversations.withColumn("n", F.sum((F.col("role") == "user").cast("long")).over(w))
    t = t.withColumn("n", F.when((F.col("role") == "system") & (F.col("n") == 0), F.lit(1).cast("long")).otherwise(F.col("n"))).where("n > 0")
    one = lambda role: F.min(F.when(F.col("role") == role, F.col("text")))
    rows = t.groupBy("conv_id", "n").agg(one("system").alias("system"), one("user").alias("Benutzer"), one("assistant").alias("Assistentin"))
    rows = with_ordinal(rows, ["conv_id", "n"], "_rowidx")
    return rows.select(
        "_rowidx", (F.col("conv_id") * 1000 + F.col("n")).cast("string").alias("id"),
        F.when(F.col("n") > 1, (F.col("conv_id") * 1000 + F.col("n") - 1).cast("string")).otherwise("").alias("parent_id"),
        F.coalesce("system", F.lit("")).alias("system"), F.coalesce("Benutzer", F.lit("")).alias("Benutzer"), F.lit("").alias("Kontext"), F.coalesce("Assistentin", F.lit("")).alias("Assistentin"))


def messages(conversations: DataFrame) -> DataFrame:
    """``conv_id, messages``: each conversation's turns as an array of (role, content)."""
    got = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return got.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
