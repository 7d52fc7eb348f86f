"""Landed pages: how many files they make."""
from helpers import boost, invoices
from pyspark.sql import functions as F

from satledger.session import scratch_path
from satledger.sources import landing


def test_files_follow_the_pages_not_the_partitions(spark):
    """One file per run of pages, also where a shuffle has many partitions: the stream's
    batches are counted in files."""
    inv = invoices(spark, [boost(i, 1704067200 + i, "s", 5, source=("wallet", "node_a", "node_b")[i % 3]) for i in range(960)])
    path = scratch_path(spark, "landed")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages = landing.node_pages(inv, page_size=5)  # 64 pages of 5 invoices a source
        pages.select("source", "value").write.partitionBy("source").text(path)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    landed = spark.read.text(path).select("source", F.col("_metadata.file_path").alias("file"))
    found = {r["source"]: (r["files"], r["pages"]) for r in landed.groupBy("source").agg(
        F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("pages")).collect()}
    assert set(found) == {"node_a", "node_b"}
    assert all(1 < files <= landing.FILES and pages == 64 for files, pages in found.values())


def test_no_pages(spark):
    assert landing.wallet_pages(invoices(spark, [boost(1, 5, "s", 5)])).count() == 0
