"""Streams of events and traces: windows with watermarks, duplicates, and runs over what is new.

Every run uses availableNow: it takes what has come since its checkpoint and ends, so a lost run is run again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.texts import shared_folder


def events(spark: SparkSession, folder: str, name: str = "events", per_batch: int = 64, time: str = "ts") -> DataFrame:
    """A stream of a table, one file or a folder of parts; times without a zone are taken in the session's, as watermarks need one."""
    at = f"{folder}/{name}.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    parts = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    source = at if parts else f"{folder}/{name}.[p]arquet"  # a stream takes a single file only as a pattern
    return spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", per_batch).parquet(source).withColumn(time, F.col(time).cast("timestamp"))


def tumbling(stream: DataFrame, width: str, late: str | None, *keys: str, time: str = "ts") -> DataFrame:
    """late: null for a whole table, whose files come in any order; no row is late then, and every window is held."""
    return (stream.withWatermark(time, late) if late else stream).groupBy(F.window(time, width).alias("w"), *keys)


def sliding(stream: DataFrame, width: str, step: str, late: str | None, *keys: str, time: str = "ts") -> DataFrame:
    return (stream.withWatermark(time, late) if late else stream).groupBy(F.window(time, width, step).alias("w"), *keys)


def sessions(stream: DataFrame, gap: str, late: str, *keys: str, time: str = "ts") -> DataFrame:
    """Sessions are closed by the watermark, so `late` must cover how far out of order rows come."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys)


def without_repeats(stream: DataFrame, late: str | None, *keys: str, time: str = "ts") -> DataFrame:
    """late: null for a whole table; no row is late then, and every key is held."""
    if not late:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def run(result: DataFrame, keys: list[str], mode: str = "update", at: str | None = None) -> DataFrame:
    """What a stream has come to: batches are tables in the shared folder, of which the last value of each key counts.

    With append, batches are simply put together. at: a folder kept between runs, for work on what is new only.
    """
    spark = result.sparkSession
    at = at or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{at}/rows/{number:09d}")

    result.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*result.schema.fields, T.StructField("batch_no", T.IntegerType())])
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{at}/rows")
    if mode == "append":
        return rows.drop("batch_no")
    rest = [c for c in result.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_no").alias("x"))
    return latest.select(*keys, "x.*")
