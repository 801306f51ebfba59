"""The driver's tables seen as evaluation data, each beside the same view in SQL.

Parts are examples, return flags are models, line statuses are judges; sums of whole
hundredths make scores, so that no average depends on the order of its terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def _mean(total, count):
    return total.cast("double") / (F.lit(100.0) * count.cast("double"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean discount by part and flag."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.sum(_cents("l_discount")).alias("s"), F.count("*").alias("n"))
    return li.select(F.lit("discount").alias("metric"), F.col("l_partkey").alias("example_id"), F.col("l_returnflag").alias("model"), _mean(F.col("s"), F.col("n")).alias("score"), F.col("l_partkey").alias("ord"))


CELLS = """cells AS (SELECT 'discount' AS metric, l_partkey AS example_id, l_returnflag AS model,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (100 * CAST(count(*) AS DOUBLE)) AS score FROM lineitem GROUP BY l_partkey, l_returnflag)"""


def binary_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 where the mean discount is 5 % or more."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.sum(_cents("l_discount")).alias("s"), F.count("*").alias("n"))
    return li.select(F.lit("discount").alias("metric"), F.col("l_partkey").alias("example_id"), F.col("l_returnflag").alias("model"), F.when(F.col("s") >= 5 * F.col("n"), 1.0).otherwise(0.0).alias("score"), F.col("l_partkey").alias("ord"))


BINARY = """cells AS (SELECT 'discount' AS metric, l_partkey AS example_id, l_returnflag AS model,
  CASE WHEN sum(CAST(round(l_discount * 100) AS BIGINT)) >= 5 * count(*) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM lineitem GROUP BY l_partkey, l_returnflag)"""


def ordinal_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity in tens, 0 to 5."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.sum(F.round("l_quantity").cast("long")).alias("s"), F.count("*").alias("n"))
    level = F.rint(F.col("s").cast("double") / (F.lit(10.0) * F.col("n").cast("double")))
    return li.select(F.lit("quantity").alias("metric"), F.col("l_partkey").alias("example_id"), F.col("l_returnflag").alias("model"), level.alias("score"), F.col("l_partkey").alias("ord"))


ORDINAL = """cells AS (SELECT 'quantity' AS metric, l_partkey AS example_id, l_returnflag AS model,
  round_even(CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) / (10 * CAST(count(*) AS DOUBLE)), 0) AS score FROM lineitem GROUP BY l_partkey, l_returnflag)"""

PAIRS = """pairs AS (SELECT *, score_b - score_a AS diff FROM (SELECT metric, example_id,
  max(CASE WHEN model = 'A' THEN score END) AS score_a, max(CASE WHEN model = 'R' THEN score END) AS score_b
  FROM cells WHERE model IN ('A', 'R') GROUP BY metric, example_id) WHERE score_a IS NOT NULL AND score_b IS NOT NULL)"""


def suite_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three metrics by unpivoting: discount, tax and quantity in whole hundredths."""
    names = ["l_discount", "l_tax", "l_quantity"]
    # lines are summed before they are unpivoted, so that a task holds a third of the groups, without names
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(*[x for c in names for x in (F.sum(_cents(c)).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"))])
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"s_{c}").alias("s"), F.col(f"n_{c}").alias("n")) for c in names])
    sums = li.select("l_partkey", "l_returnflag", F.inline(each)).where("n > 0")
    return sums.select("metric", F.col("l_partkey").alias("example_id"), F.col("l_returnflag").alias("model"), _mean(F.col("s"), F.col("n")).alias("score"), F.col("l_partkey").alias("ord"))


SUITE = """cells AS (SELECT metric, l_partkey AS example_id, l_returnflag AS model,
  CAST(sum(CAST(round(raw * 100) AS BIGINT)) AS DOUBLE) / (100 * CAST(count(*) AS DOUBLE)) AS score
  FROM (UNPIVOT (SELECT l_partkey, l_returnflag, l_discount, l_tax, l_quantity FROM lineitem) ON l_discount, l_tax, l_quantity INTO NAME metric VALUE raw)
  GROUP BY metric, l_partkey, l_returnflag)"""


def binary_suite_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three metrics of 0 and 1: whether a part's mean discount, tax or quantity is above a bar."""
    bars = F.create_map(*[x for k, v in BARS.items() for x in (F.lit(k), F.lit(v / 100))])
    return suite_cells(spark, sf_dir).withColumn("score", F.when(F.col("score") > bars[F.col("metric")], 1.0).otherwise(0.0))


BARS = {"l_discount": 5, "l_tax": 4, "l_quantity": 2550}  # in hundredths
BINARY_SUITE = f"""many AS (SELECT metric, l_partkey AS example_id, l_returnflag AS model, sum(CAST(round(raw * 100) AS BIGINT)) AS s, count(*) AS n
  FROM (UNPIVOT (SELECT l_partkey, l_returnflag, l_discount, l_tax, l_quantity FROM lineitem) ON l_discount, l_tax, l_quantity INTO NAME metric VALUE raw) GROUP BY ALL),
cells AS (SELECT metric, example_id, model, CASE WHEN CAST(s AS DOUBLE) / (100 * CAST(n AS DOUBLE)) > CASE metric {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE / 100" for k, v in BARS.items())} END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM many)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a run of its part and flag, numbered in the order of all columns."""
    li = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_partkey", "l_returnflag").orderBy(*LINE_ORDER)
    size = F.count("*").over(W.partitionBy("l_partkey", "l_returnflag"))
    numbered = li.select(F.lit("discount").alias("metric"), F.col("l_partkey").alias("example_id"), F.col("l_returnflag").alias("model"), (F.row_number().over(order) - 1).alias("run_idx"), (_cents("l_discount").cast("double") / 100.0).alias("score"), size.alias("size"))
    return numbered.where("size > 1").drop("size")


RUNS = f"""runs AS (SELECT * EXCLUDE (size) FROM (SELECT 'discount' AS metric, l_partkey AS example_id, l_returnflag AS model,
  row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY {', '.join(LINE_ORDER)}) - 1 AS run_idx,
  CAST(CAST(round(l_discount * 100) AS BIGINT) AS DOUBLE) / 100 AS score, count(*) OVER (PARTITION BY l_partkey, l_returnflag) AS size FROM lineitem) WHERE size > 1)"""


def judge_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line status judges part and flag: 1 for a mean discount of 5 % or more."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag", "l_linestatus").agg(F.sum(_cents("l_discount")).alias("s"), F.count("*").alias("n"))
    return li.select(F.col("l_partkey").alias("example_id"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("judge"), F.when(F.col("s") >= 5 * F.col("n"), 1.0).otherwise(0.0).alias("score"), F.ascii("l_linestatus").alias("judge_ord"))


JUDGED = """judged AS (SELECT l_partkey AS example_id, l_returnflag AS model, l_linestatus AS judge, ascii(l_linestatus) AS judge_ord,
  CASE WHEN sum(CAST(round(l_discount * 100) AS BIGINT)) >= 5 * count(*) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM lineitem GROUP BY l_partkey, l_returnflag, l_linestatus)"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean discount by part, flag and status, as a graded judgement."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag", "l_linestatus").agg(F.sum(_cents("l_discount")).alias("s"), F.count("*").alias("n"))
    return li.select(F.col("l_partkey").alias("example_id"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("judge"), _mean(F.col("s"), F.col("n")).alias("score"), F.ascii("l_linestatus").alias("judge_ord"))


GRADED = """judged AS (SELECT l_partkey AS example_id, l_returnflag AS model, l_linestatus AS judge,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (100 * CAST(count(*) AS DOUBLE)) AS score FROM lineitem GROUP BY l_partkey, l_returnflag, l_linestatus)"""


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each status prefers the flag, A or R, with the greater mean discount of a part."""
    li = table(spark, sf_dir, "lineitem")
    pick = lambda m, v: F.sum(F.when(F.col("l_returnflag") == m, v).otherwise(0))
    two = li.groupBy("l_partkey", "l_linestatus").agg(pick("A", _cents("l_discount")).alias("sa"), pick("A", F.lit(1)).alias("na"), pick("R", _cents("l_discount")).alias("sr"), pick("R", F.lit(1)).alias("nr")).where("na > 0 AND nr > 0")
    a, r = F.col("sa") * F.col("nr"), F.col("sr") * F.col("na")
    return two.select(F.col("l_partkey").alias("example_id"), F.col("l_linestatus").alias("judge"), F.when(a > r, "A").when(r > a, "R").alias("winner"), (a == r).alias("is_tie"))


PREFS = """prefs AS (SELECT example_id, judge, CASE WHEN sa * nr > sr * na THEN 'A' WHEN sr * na > sa * nr THEN 'R' END AS winner, sa * nr = sr * na AS is_tie FROM (
  SELECT l_partkey AS example_id, l_linestatus AS judge, sum(CASE WHEN l_returnflag = 'A' THEN CAST(round(l_discount * 100) AS BIGINT) ELSE 0 END) AS sa, count(*) FILTER (WHERE l_returnflag = 'A') AS na,
  sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_discount * 100) AS BIGINT) ELSE 0 END) AS sr, count(*) FILTER (WHERE l_returnflag = 'R') AS nr FROM lineitem GROUP BY 1, 2) WHERE na > 0 AND nr > 0)"""


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), F.col("p_brand").alias("group_id"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))


def run_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean order price by priority."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model"), F.date_trunc("month", "o_orderdate").alias("run_ord")).agg(F.sum(_cents("o_totalprice")).alias("s"), F.count("*").alias("n"))
    return o.select("model", "run_ord", _mean(F.col("s"), F.col("n")).alias("score"))


RUN_LEVEL = """totals AS (SELECT o_orderpriority AS model, date_trunc('month', o_orderdate) AS run_ord,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (100 * CAST(count(*) AS DOUBLE)) AS score FROM orders GROUP BY 1, 2)"""


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels as the gold judge, the length of a document as another."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    sides = F.array(
        F.struct(F.lit("gold").alias("judge"), F.col("quality").cast("double").alias("score"), F.lit(0).alias("judge_ord")),
        F.struct(F.lit("length").alias("judge"), F.when(F.col("n_chars") >= 500, 1.0).otherwise(0.0).alias("score"), F.lit(1).alias("judge_ord")),
        F.struct(F.lit("toxicity").alias("judge"), (1 - F.col("toxic")).cast("double").alias("score"), F.lit(2).alias("judge_ord")),
    )
    return both.select(F.col("doc_id").alias("example_id"), F.lit("all").alias("model"), F.inline(sides))


CALIBRATION = """judged AS (SELECT doc_id AS example_id, 'gold' AS judge, CAST(quality AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, 'length', CASE WHEN n_chars >= 500 THEN 1.0 ELSE 0.0 END FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, 'toxicity', CAST(1 - toxic AS DOUBLE) FROM labels JOIN documents USING (doc_id))"""


def raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score fields as files have them: numbers, percentages, words, and what is none."""
    raw = F.expr("CASE event_id % 6 WHEN 0 THEN CAST(event_id AS string) WHEN 1 THEN concat(event_id % 101, '%') WHEN 2 THEN ' Pass ' WHEN 3 THEN 'FAILED' WHEN 4 THEN concat('-', event_id % 7, '.5e-1') ELSE event_type END")
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


RAW = """raw AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN (event_id % 101) || '%' WHEN 2 THEN ' Pass ' WHEN 3 THEN 'FAILED'
  WHEN 4 THEN '-' || (event_id % 7) || '.5e-1' ELSE event_type END AS raw FROM events)"""


def labelled_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with a label, as a benchmark, and all others, as the training corpus."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct()
    return docs.join(ids, "id", "left_semi"), docs.join(ids, "id", "left_anti")
