"""Running a stream to the end of its input, and streaming reports and answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine.session import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all available input into a Parquet table in the shared folder and read it."""
    spark = stream.sparkSession
    path = shared_folder(spark, name)
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet")
            .outputMode(mode)
            .option("path", f"{path}/out")
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def answer_committed(
    events: DataFrame, requests: DataFrame, answer: Callable[[DataFrame], DataFrame], name: str, once_within: str = "1 day"
) -> DataFrame:
    """Committed transcripts only reach the answer flow; partials never do.

    `events` has request_id, event and ts. A request committed again within `once_within` of event time
    is answered once: Spark keeps the ids of that span and drops them as the watermark passes, so
    neither the state nor a batch grows with all ids ever asked; a later repeat is a new question. Commits later than that behind
    the newest are dropped. Each micro-batch joins its ids with the request table and
    writes its own folder, so a repeated batch overwrites instead of doubling.
    """
    spark: SparkSession = events.sparkSession
    path = shared_folder(spark, name)
    answer(requests.limit(0)).write.parquet(f"{path}/out/batch=-1")

    def run(batch: DataFrame, batch_id: int) -> None:
        asked = requests.join(batch.select("request_id"), "request_id", "left_semi")
        answer(asked).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    committed = events.where(F.col("event") == "committed").select("request_id", "ts").withWatermark("ts", once_within)
    query = (
        committed.dropDuplicatesWithinWatermark(["request_id"])
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


def latency_windows(events: DataFrame, length: str, lateness: str, target_ms: float) -> DataFrame:
    """Latency report per stage and tumbling window; late rows beyond the watermark are dropped.

    Count, mean, maximum and the gate are exact; p50 and p70 come from a bounded sketch.
    """
    done = ~F.col("failed")
    ms = F.when(done, F.col("ms"))
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", length).alias("w"), "stage")
        .agg(
            F.count(ms).alias("samples"),
            F.count_if("failed").alias("failed"),
            F.avg(ms).alias("mean"),
            F.percentile_approx(ms, F.array(F.lit(0.5), F.lit(0.7)), F.lit(1000)).alias("p"),
            F.max(ms).alias("p100"),
        )
        .select(
            F.col("w.start").alias("window_start"), "stage", "samples", "failed", "mean",
            F.col("p")[0].alias("p50"), F.col("p")[1].alias("p70"), "p100",
            ((F.col("failed") == 0) & (F.col("p100") <= target_ms)).alias("all_attempts_meet_target"),
        )
    )
