"""Agreement of judges with each other and with a reference judge.

``cells`` has example_id, model, judge, score and judge_ord (first appearance).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import midranks

ITEM = ["example_id", "model"]
REFERENCE_NAMES = ("gold", "human", "reference", "ground_truth", "truth", "expert")


def common_items(cells: DataFrame) -> DataFrame:
    """Cells of the items that every judge has scored."""
    judges = cells.agg(F.countDistinct("judge").alias("all_judges"))
    full = cells.groupBy(*ITEM).agg(F.countDistinct("judge").alias("k")).join(F.broadcast(judges)).where("k = all_judges").select(*ITEM)
    return cells.join(full, ITEM, "left_semi")


def judge_pairs(cells: DataFrame) -> DataFrame:
    """Equality rate of every pair of judges. Judges of an item are gathered once, so
    there is one shuffle and no self-join."""
    items = cells.groupBy(*ITEM).agg(F.sort_array(F.collect_list(F.struct("judge", "score"))).alias("r"))
    two = F.flatten(F.transform("r", lambda x: F.transform(F.filter("r", lambda y: y["judge"] > x["judge"]), lambda y: F.struct(x["judge"].alias("judge_1"), y["judge"].alias("judge_2"), (x["score"] == y["score"]).cast("int").alias("same")))))
    return items.select(F.inline(two)).groupBy("judge_1", "judge_2").agg(F.sum("same").alias("n_same"), F.count("*").alias("n_items"), F.avg("same").alias("agreement"))


def percent_agreement(cells: DataFrame) -> DataFrame:
    return judge_pairs(cells).agg(F.avg("agreement").alias("percent_agreement"), F.count("*").alias("n_pairs"))


def cohen_kappa(cells: DataFrame, one: str, two: str) -> DataFrame:
    """Two raters; 1 where chance agreement is certain."""
    pick = lambda j: F.max(F.when(F.col("judge") == j, F.col("score")))
    both = cells.where(F.col("judge").isin(one, two)).groupBy(*ITEM).agg(pick(one).alias("x"), pick(two).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    table = both.groupBy("x", "y").agg(F.count("*").alias("n"))
    n = table.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    side = lambda c: table.groupBy(F.col(c).alias("v")).agg(F.sum("n").alias(f"n_{c}"))
    chance = side("x").join(side("y"), "v").agg(F.coalesce(F.sum(F.col("n_x") * F.col("n_y")), F.lit(0)).alias("c"))
    po, pe = F.col("same") / F.col("total"), F.col("c") / (F.col("total") * F.col("total"))
    kappa = F.when(pe == 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe))
    return n.join(F.broadcast(chance)).select(kappa.alias("cohen_kappa"), F.col("total").alias("n_items"))


def fleiss_kappa(cells: DataFrame) -> DataFrame:
    """Many raters, as many for each item; 1 where chance agreement is certain."""
    table = cells.groupBy(*ITEM, "score").agg(F.count("*").alias("n"))
    items = table.groupBy(*ITEM).agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    agree = items.agg(F.avg((F.col("sq") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("p"), F.sum("r").alias("total"), F.count("*").alias("n_items"))
    cats = table.groupBy("score").agg(F.sum("n").alias("c")).join(F.broadcast(agree.select("total"))).agg(F.sum((F.col("c") / F.col("total")) * (F.col("c") / F.col("total"))).alias("pe"))
    kappa = F.when(F.col("pe") >= 1 - 1e-12, 1.0).otherwise(F.try_divide(F.col("p") - F.col("pe"), 1 - F.col("pe")))
    return agree.join(F.broadcast(cats)).select(kappa.alias("fleiss_kappa"), "n_items")


def outlier_judge(cells: DataFrame) -> DataFrame:
    """Mean agreement of each judge with the others, and which one has the least (the
    first declared on ties)."""
    pairs = judge_pairs(cells)
    each = pairs.select(F.col("judge_1").alias("judge"), "agreement").unionByName(pairs.select(F.col("judge_2").alias("judge"), "agreement"))
    order = cells.groupBy("judge").agg(F.min("judge_ord").alias("ord"))
    mean = each.groupBy("judge").agg(F.avg("agreement").alias("mean_agreement")).join(order, "judge")
    first = F.row_number().over(W.orderBy("mean_agreement", "ord"))  # a row per judge
    return mean.select("judge", "mean_agreement", (first == 1).alias("is_outlier"))


def consensus(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Each judge's winner by its own means (b on ties), of judges that saw both models."""
    mean = lambda m: F.avg(F.when(F.col("model") == m, F.col("score")))
    each = cells.groupBy("judge").agg(mean(a).alias("mean_a"), mean(b).alias("mean_b")).where("mean_a IS NOT NULL AND mean_b IS NOT NULL")
    each = each.withColumn("winner", F.when(F.col("mean_b") >= F.col("mean_a"), b).otherwise(a))
    return each.withColumn("unanimous", F.size(F.collect_set("winner").over(W.partitionBy(F.lit(1)))) == 1)


def against(cells: DataFrame, reference: str) -> DataFrame:
    """Items of every judge beside the reference's score."""
    gold = cells.where(F.col("judge") == reference).select(*ITEM, F.col("score").alias("reference_score"))
    return cells.where(F.col("judge") != reference).join(gold, ITEM)


def calibration_exact(cells: DataFrame, reference: str) -> DataFrame:
    return against(cells, reference).groupBy("judge").agg(F.sum((F.col("score") == F.col("reference_score")).cast("int")).alias("matches"), F.count("*").alias("total")).withColumn("accuracy", F.col("matches") / F.col("total"))


def calibration_spearman(cells: DataFrame, reference: str) -> DataFrame:
    """Rank correlation with the reference; null below two items or without variation."""
    both = against(cells, reference).select("judge", *ITEM, "score", "reference_score")
    ranked = midranks(midranks(both, "score", ["judge"], name="x"), "reference_score", ["judge"], name="y")
    m = ranked.groupBy("judge").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    return m.select("judge", "n", F.when((vx > 0) & (vy > 0), F.try_divide(n * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(vx) * F.sqrt(vy))).alias("spearman"))
