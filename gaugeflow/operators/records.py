"""From observation rows to cells: one score per (metric, example, model).

``records`` has metric, example_id, model, judge (null for a plain score), score and
row_ord, the place of the row in its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = ["metric", "example_id", "model"]


def judge_cells(records: DataFrame) -> DataFrame:
    """One score per judge: of repeated ones the last row counts."""
    return (
        records.where("judge IS NOT NULL")
        .groupBy(*CELL, "judge")
        .agg(F.max(F.struct("row_ord", "score")).alias("last"), F.min("row_ord").alias("judge_ord"))
        .select(*CELL, "judge", F.col("last.score").alias("score"), "judge_ord")
    )


def run_cells(records: DataFrame) -> DataFrame:
    """Plain rows numbered from 0 in source order, where a cell has more than one and no judge."""
    order = W.partitionBy(*CELL).orderBy("row_ord")
    whole = W.partitionBy(*CELL)
    return (
        records.withColumn("n_plain", F.count_if(F.col("judge").isNull()).over(whole))
        .withColumn("n_judged", F.count("judge").over(whole))
        .where("judge IS NULL AND n_judged = 0 AND n_plain > 1")
        .select(*CELL, (F.row_number().over(order) - 1).alias("run_idx"), "score")
    )


def score_cells(records: DataFrame) -> DataFrame:
    """Mean over judges where there are any (plain rows then don't count), else over plain
    rows; with the first place of the example."""
    plain = records.groupBy(*CELL).agg(
        F.avg(F.when(F.col("judge").isNull(), F.col("score"))).alias("plain"), F.count("judge").alias("n_judged"), F.min("row_ord").alias("ord")
    )
    judged = judge_cells(records).groupBy(*CELL).agg(F.avg("score").alias("judged"))
    score = F.when(F.col("n_judged") > 0, F.col("judged")).otherwise(F.col("plain"))
    return plain.join(judged, CELL, "left").select(*CELL, score.alias("score"), "ord")


def models_in_order(records: DataFrame) -> DataFrame:
    """Models by first appearance."""
    return records.groupBy("metric", "model").agg(F.min("row_ord").alias("model_ord"))


def model_means(cells: DataFrame) -> DataFrame:
    return cells.groupBy("metric", "model").agg(F.avg("score").alias("mean_score"), F.count("score").alias("n"))


def top_models(means: DataFrame, order: DataFrame, count: int = 2) -> DataFrame:
    """The best models of each metric; ties go to the one declared first."""
    by = W.partitionBy("metric").orderBy(F.desc("mean_score"), "model_ord")
    return means.join(order, ["metric", "model"]).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= count).drop("model_ord")


def model_ranking(means: DataFrame) -> DataFrame:
    """All models by mean; ties by name."""
    return means.withColumn("rank", F.row_number().over(W.partitionBy("metric").orderBy(F.desc("mean_score"), "model")))


def suite_pair(cells: DataFrame, order: DataFrame, count: int = 2) -> DataFrame:
    """The pair that a suite compares: by the mean of a model's means per metric."""
    means = model_means(cells).groupBy("model").agg(F.avg("mean_score").alias("mean_score"))
    declared = order.groupBy("model").agg(F.min("model_ord").alias("model_ord"))
    top = means.join(declared, "model").withColumn("rank", F.row_number().over(W.orderBy(F.desc("mean_score"), "model_ord")))
    return top.where(F.col("rank") <= count).drop("model_ord")
