"""Streaming ingest: new documents once, by source and content, into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from basketlens.functions import privacy


def read(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(stream: DataFrame, source: str, text: str, time: str, late: str = "7 days") -> DataFrame:
    """Each (source, content) once; what is later than ``late`` is no longer remembered."""
    keyed = stream.withColumn("content_hash", F.sha2(text, 256))
    return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark([source, "content_hash"])


def redacted(stream: DataFrame, text: str) -> DataFrame:
    """Personal data goes before anything is stored."""
    return stream.withColumn("__r", privacy.redact(text)).withColumn(text, F.col("__r.text")).withColumn("n_redactions", F.col("__r.total")).drop("__r")


def windowed_counts(stream: DataFrame, time: str, group: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, length), group).agg(F.count("*").alias("n"))


def start(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there and stops; to be run again for more."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def start_keyed(stream: DataFrame, out: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """As start(), but each key once however late it comes again: a batch adds only keys that the table has not, also when it is run twice."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key)
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(out).select(*key), key, "left_anti").select(*batch.columns)
        new.write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
