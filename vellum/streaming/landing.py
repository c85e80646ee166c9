"""Page records that land in a folder: each document is published once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def landed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of JSON page records."""
    return spark.readStream.schema(schema).json(folder)


def complete_documents(pages: DataFrame) -> DataFrame:
    """Documents of which all pages have landed in this batch."""
    return pages.groupBy("doc").agg(F.countDistinct("page").alias("n"), F.max("n_pages").alias("n_pages")).where("n = n_pages").select("doc", "n_pages")


def publish(stream: DataFrame, out: str, checkpoint: str):
    """Append page records not yet published by (doc, page); a batch that is run again adds nothing.

    The published table is partitioned by a hash of the document, and a batch is compared with the partitions of its own
    documents only.
    """

    def once(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["doc", "page"]).withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(BUCKETS)).cast("int"))
        try:
            old = batch.sparkSession.read.parquet(out)
        except Exception as e:  # nothing published yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
            new = new.join(old.where(F.col("bucket").isin(touched)).select("doc", "page"), ["doc", "page"], "left_anti")
        new.write.mode("append").partitionBy("bucket").parquet(out)

    return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
