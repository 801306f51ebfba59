"""Score records that keep arriving: an extension beyond batch audits.

The state of a comparison is a row of sums per (metric, example, model), which add up in
any order; a batch is applied once, whatever the number of its attempts. Findings are
computed from the totals with the batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ["metric", "example_id", "model"]


class ScoreTotals:
    """Totals below ``path``: a folder per micro-batch, overwritten by a repeated attempt."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """A batch's sums; written to the folder of its number, so a replay replaces itself."""
        sums = batch.where("score IS NOT NULL").groupBy(*KEY).agg(F.sum("score").alias("s"), F.count("*").alias("n"), F.min("row_ord").alias("ord"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def cells(self) -> DataFrame:
        """(metric, example_id, model, score, ord) of all that has arrived."""
        all_ = self.spark.read.parquet(self.path)
        return all_.groupBy(*KEY).agg((F.sum("s") / F.sum("n")).alias("score"), F.min("ord").alias("ord"))

    def start(self, records: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Feed a stream of records; ``trigger`` as in ``writeStream.trigger``."""
        return records.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_means(records: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Mean score by model and time window; rows later than ``late`` are dropped."""
    return records.withWatermark(time, late).groupBy(F.window(time, width), "metric", "model").agg(F.avg("score").alias("mean_score"), F.count("score").alias("n"))
