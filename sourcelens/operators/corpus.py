"""The engine's input, corpus(path, text), from tables of other shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A single Parquet file of this many bytes is dealt out, as it often is one row group, which one task reads.
SINGLE_FILE = (1 << 20, 64 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table. A small one in a single file is dealt out over the cores, whole rows; a folder of
    files, or a large file, is read as it is split."""
    where = f"{sf_dir}/{name}.parquet"
    df, path = spark.read.parquet(where), spark._jvm.org.apache.hadoop.fs.Path(where)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    small = status.isFile() and SINGLE_FILE[0] <= status.getLen() <= SINGLE_FILE[1]
    return df.repartition(spark.sparkContext.defaultParallelism) if small else df


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table as a stream. Streams read folders, so a table in a single file is named by a pattern."""
    where = f"{sf_dir}/{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    one_file = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    return spark.readStream.schema(spark.read.parquet(where).schema).parquet(f"{where}*" if one_file else where)


def of_documents(df: DataFrame) -> DataFrame:
    return df.select(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")


def page_path() -> Column:
    return F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("#"), F.col("page_id").cast("string"))


def of_pages(df: DataFrame) -> DataFrame:
    return df.select(page_path().alias("path"), F.col("html").alias("text"))


def of_conversations(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("-"), "role").alias("path"), "text")


def of_benchmark(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("path"), "text")
