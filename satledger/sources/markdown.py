"""A directory of Markdown files, one row per file with its whole text."""
from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satledger.operators.ranking import global_rank


def read_markdown_dir(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """``file_name`` (base name) and ``text`` (whole file) per ``.md`` file."""
    # the scan names files as in a URL, where a plus sign stands for itself
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    return (spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
            .select(name.alias("file_name"), F.col("value").alias("text")))


def ranked_markdown_dir(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """The files with ``rank``, their place in name order (from 1)."""
    return global_rank(read_markdown_dir(spark, path, glob), F.col("file_name"))


def write_markdown_dir(files: DataFrame, path: str) -> None:
    """Land ``file_name``, ``text`` as files of these names, one row each; a newline ends a file.

    Spark writes a folder per name; the driver then only renames its single file."""
    spark = files.sparkSession
    (files.select("text", F.col("file_name").alias("name")).repartition("name").write
     .partitionBy("name").text(f"{path}/_landing"))
    jvm = spark.sparkContext._jvm
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.globStatus(Path(f"{path}/_landing/name=*/part-*")):
        name = unquote(s.getPath().getParent().getName()[5:])
        fs.rename(s.getPath(), Path(f"{path}/{name}"))
    fs.delete(Path(f"{path}/_landing"), True)
