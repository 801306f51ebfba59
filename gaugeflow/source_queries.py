"""Queries that load what evaluation tools write: the customers, as examples with their
balance as score, are written as files of each format and read back by ``sources``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.data import EvalFrames
from .queries import query, r6
from .scratch import folder
from .sources import load
from .streaming.incremental import ScoreTotals, windowed_means
from .views import CELLS, table


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer")


def _cells(data: EvalFrames) -> DataFrame:
    return data.cells.select("metric", "example_id", "model", *r6("score"))


def _document(spark, sf, name: str, element: str, before: str = "[", after: str = "]", suffix: str = "json") -> str:
    """One JSON document with an element per customer; such a document is a single record.
    One task writes it, a line an element, and never holds more than some of them."""
    path = f"{folder(spark, name)}/{name}.{suffix}"

    def lines(batches):
        first = True
        for b in batches:
            out = []
            for part, text in zip(b["part"].to_pylist(), b["e"].to_pylist()):
                out.append(text if part != 1 or first else f",{text}")
                first = first and part != 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["t"])

    rows = _customers(spark, sf).selectExpr("1 AS part", "CAST(c_custkey AS bigint) AS k", f"to_json({element}) AS e")
    ends = spark.createDataFrame([(0, None, before), (2, None, after)], "part int, k bigint, e string")
    rows.unionByName(ends).repartition(1).sortWithinPartitions("part", "k", "e").select("part", "e").mapInArrow(lines, "t string").write.text(path)
    return path


def _lines(spark, sf, name: str, *elements: str) -> str:
    path = f"{folder(spark, name)}/{name}.jsonl"
    _customers(spark, sf).selectExpr(f"explode(filter(array({', '.join(elements)}), x -> x IS NOT NULL)) AS line").write.text(path)
    return path


def _csv(spark, sf, name: str, *columns: str) -> str:
    path = f"{folder(spark, name)}/{name}.csv"
    _customers(spark, sf).selectExpr(*columns).write.csv(path, header=True)
    return path


_LONG = "CAST(c_custkey AS VARCHAR) AS example_id, 'm' || (c_nationkey % 3) AS model, round(c_acctbal, 6) AS score FROM customer"
_MODEL = "concat('m', c_nationkey % 3)"


@query("load_csv_long", f"SELECT 'score' AS metric, {_LONG}")
def load_csv_long(spark, sf):
    return _cells(load.load_suite(spark, _csv(spark, sf, "long", "c_custkey AS ID", f"{_MODEL} AS Model", "c_acctbal AS Score", "c_name AS note")))


@query("load_csv_wide", "SELECT 'score' AS metric, CAST(c_custkey AS VARCHAR) AS example_id, 'first' AS model, round(c_acctbal, 6) AS score FROM customer UNION ALL SELECT 'score', CAST(c_custkey AS VARCHAR), 'second', CAST(c_nationkey AS DOUBLE) / 100 FROM customer")
def load_csv_wide(spark, sf):
    return _cells(load.load_suite(spark, _csv(spark, sf, "wide", "c_custkey AS id", "c_acctbal AS first", "concat(c_nationkey, '%') AS second", "c_mktsegment AS note")))


@query("load_csv_metrics", "SELECT c_mktsegment AS metric, CAST(c_custkey AS VARCHAR) AS example_id, 'm' || (c_nationkey % 3) AS model, round(c_acctbal, 6) AS score FROM customer")
def load_csv_metrics(spark, sf):
    return _cells(load.load_suite(spark, _csv(spark, sf, "metrics", "c_custkey AS id", f"{_MODEL} AS model", "c_mktsegment AS metric", "c_acctbal AS score")))


_ODD = "c_mktsegment = 'BUILDING'"


@query("load_jsonl_long", f"SELECT 'score' AS metric, {_LONG} WHERE NOT ({_ODD})")
def load_jsonl_long(spark, sf):
    return _cells(load.load_suite(spark, _skipping(spark, sf)))


def _skipping(spark, sf) -> str:
    return _lines(spark, sf, "skipping", f"to_json(named_struct('id', c_custkey, 'model', {_MODEL}, 'score', CASE WHEN {_ODD} THEN 'unknown' ELSE CAST(c_acctbal AS string) END))")


@query("load_skipped", f"SELECT count(*) FILTER (WHERE {_ODD}) AS skipped, count(*) FILTER (WHERE NOT ({_ODD})) AS kept FROM customer")
def load_skipped(spark, sf):
    about = load.load_suite(spark, _skipping(spark, sf)).metadata
    return spark.createDataFrame([(about["skipped_rows"], about["kept"])], "skipped bigint, kept bigint")


@query("load_jsonl_late_models", "SELECT 'score' AS metric, CAST(c_custkey AS VARCHAR) AS example_id, 'early' AS model, round(c_acctbal, 6) AS score FROM customer UNION ALL SELECT 'score', CAST(c_custkey AS VARCHAR), 'late', 1.0::DOUBLE FROM customer WHERE c_custkey % 2 = 1")
def load_jsonl_late_models(spark, sf):
    """The second model is in no row before the second one."""
    return _cells(load.load_suite(spark, _lines(spark, sf, "late", "CASE WHEN c_custkey % 2 = 1 THEN to_json(named_struct('id', c_custkey, 'early', c_acctbal, 'late', true)) ELSE to_json(named_struct('id', c_custkey, 'early', c_acctbal)) END")))


@query("load_json_records", f"SELECT 'score' AS metric, {_LONG}")
def load_json_records(spark, sf):
    return _cells(load.load_suite(spark, _document(spark, sf, "records", f"named_struct('example_id', c_custkey, 'model', {_MODEL}, 'score', c_acctbal)", '{"results": [', "]}")))


@query("load_misnamed_array", f"SELECT 'score' AS metric, {_LONG}")
def load_misnamed_array(spark, sf):
    """A JSON array in a file named as JSON lines."""
    return _cells(load.load_suite(spark, _document(spark, sf, "array", f"named_struct('id', c_custkey, 'model', {_MODEL}, 'score', c_acctbal)", suffix="jsonl")))


@query("load_preferences", "SELECT CAST(c_custkey AS VARCHAR) AS example_id, 'default' AS judge, CASE c_nationkey % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' END AS winner, c_nationkey % 3 = 2 AS is_tie FROM customer")
def load_preferences(spark, sf):
    path = _csv(spark, sf, "preferred", "c_custkey AS id", "c_acctbal AS first", "c_nationkey AS second", "CASE c_nationkey % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'Tie' END AS winner")
    return load.load_suite(spark, path).preferences.select("example_id", "judge", "winner", "is_tie")


# exports of tools, one after the other

_ONE = "CAST(c_custkey AS VARCHAR) AS example_id, 'model' AS model"
_PLACE = "CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS VARCHAR) AS example_id, 'model' AS model"


@query("load_promptfoo", f"SELECT 'score' AS metric, {_LONG}")
def load_promptfoo(spark, sf):
    return _cells(load.load_suite(spark, _document(spark, sf, "promptfoo", f"named_struct('provider', named_struct('id', {_MODEL}), 'testIdx', c_custkey, 'score', c_acctbal)", '{"version": 3, "results": {"results": [', "]}}")))


@query("load_deepeval", "SELECT 'score' AS metric, c_name AS example_id, 'judge' AS model, CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM customer")
def load_deepeval(spark, sf):
    return _cells(load.load_suite(spark, _document(spark, sf, "deepeval", "named_struct('name', c_name, 'success', c_acctbal > 0, 'metricsData', array(named_struct('score', 0.5)))", '{"hyperparameters": {"model": "judge"}, "testCases": [', "]}")))


@query("load_openevals", f"SELECT c_mktsegment AS metric, {_ONE}, round(c_acctbal, 6) AS score FROM customer")
def load_openevals(spark, sf):
    return _cells(load.load_suite(spark, _document(spark, sf, "openevals", "named_struct('key', c_mktsegment, 'id', c_custkey, 'score', c_acctbal, 'comment', 'none')")))


@query("load_inspect", "SELECT 'grade' AS metric, CAST(c_custkey AS VARCHAR) AS example_id, 'tested' AS model, CASE c_nationkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0 WHEN 2 THEN 0.5 ELSE 0.0 END AS score FROM customer UNION ALL SELECT 'length', CAST(c_custkey AS VARCHAR), 'tested', round(c_acctbal, 6) FROM customer")
def load_inspect(spark, sf):
    grades = "named_struct('grade', named_struct('value', substr('CIPN', c_nationkey % 4 + 1, 1)), 'length', named_struct('value', CAST(c_acctbal AS string)))"
    return _cells(load.load_suite(spark, _document(spark, sf, "inspect", f"named_struct('id', c_custkey, 'scores', {grades})", '{"eval": {"model": "tested"}, "samples": [', "]}")))


@query("load_langfuse", "SELECT c_mktsegment AS metric, c_name AS example_id, 'model' AS model, round(c_acctbal, 6) AS score FROM customer")
def load_langfuse(spark, sf):
    return _cells(load.load_suite(spark, _document(spark, sf, "langfuse", "named_struct('id', c_custkey, 'name', c_mktsegment, 'value', c_acctbal, 'dataType', 'NUMERIC', 'traceId', c_name)", '{"data": [', '], "meta": {"page": 1, "totalPages": 1}}')))


@query("load_langsmith", f"SELECT 'score' AS metric, {_ONE}, round((c_acctbal + c_nationkey) / 2, 6) AS score FROM customer")
def load_langsmith(spark, sf):
    stats = "named_struct('a', named_struct('avg', c_acctbal), 'b', named_struct('avg', c_nationkey))"
    return _cells(load.load_suite(spark, _document(spark, sf, "langsmith", f"named_struct('reference_example_id', CAST(c_custkey AS string), 'feedback_stats', {stats})")))


@query("load_ragas", f"SELECT 'score' AS metric, {_PLACE}, round((c_acctbal + c_nationkey) / 2, 6) AS score FROM customer")
def load_ragas(spark, sf):
    return _cells(load.load_suite(spark, _document(spark, sf, "ragas", "named_struct('user_input', c_name, 'faithfulness', c_acctbal, 'answer_relevancy', c_nationkey, 'unknown', 7)")))


@query("load_helm", f"SELECT 'exact_match' AS metric, {_ONE}, round(c_acctbal, 6) AS score FROM customer")
def load_helm(spark, sf):
    """Without the bookkeeping statistic."""
    stat = lambda name, value: f"named_struct('name', named_struct('name', '{name}'), 'mean', {value})"
    return _cells(load.load_suite(spark, _document(spark, sf, "helm", f"named_struct('instance_id', CAST(c_custkey AS string), 'stats', array({stat('exact_match', 'c_acctbal')}, {stat('num_trials', '1.0D')}))")))


@query("load_primary_metric", "SELECT 'score' AS metric, CAST(c_custkey AS VARCHAR) AS example_id, 'model' AS model, round(c_acctbal, 6) AS score FROM customer")
def load_primary_metric(spark, sf):
    """The one metric of several that a single audit takes: a preferred one, not the first."""
    stat = lambda name, value: f"named_struct('name', named_struct('name', '{name}'), 'mean', {value})"
    path = _document(spark, sf, "primary", f"named_struct('instance_id', CAST(c_custkey AS string), 'stats', array({stat('aaa', 'CAST(c_nationkey AS double)')}, {stat('f1_score', 'c_acctbal')}))")
    return _cells(load.load(spark, path))


@query("load_mlflow", f"SELECT 'match' AS metric, {_PLACE}, round(c_acctbal, 6) AS score FROM customer UNION ALL SELECT 'latency', {_PLACE}, CAST(c_nationkey AS DOUBLE) FROM customer")
def load_mlflow(spark, sf):
    return _cells(load.load_suite(spark, _document(spark, sf, "mlflow", "array(c_name, CAST(c_acctbal AS string), CAST(c_nationkey AS string))", '{"eval_results_table": {"columns": ["text", "match/score", "latency"], "data": [', "]}}")))


@query("load_lighteval", "SELECT 'acc' AS metric, 'task:' || c_custkey AS example_id, 'model' AS model, round(c_acctbal, 6) AS score FROM customer")
def load_lighteval(spark, sf):
    doc = "named_struct('id', c_custkey, 'task_name', 'task', 'query', c_name, 'choices', array('a'), 'gold_index', 0)"
    return _cells(load.load_suite(spark, _document(spark, sf, "lighteval", f"named_struct('doc', {doc}, 'metric', named_struct('acc', c_acctbal, 'acc_stderr', 0.5))")))


def _native(spark, sf) -> EvalFrames:
    runs = "named_struct('A', array(c_acctbal, c_acctbal + 1), 'B', array(c_nationkey, c_nationkey))"
    judges = "named_struct('gold', named_struct('A', 1, 'B', c_nationkey % 2), 'other', named_struct('A', c_nationkey % 2, 'B', 1))"
    one = f"named_struct('id', c_custkey, 'scores', named_struct('A', c_acctbal, 'B', c_nationkey), 'runs', {runs}, 'judges', {judges}, 'attributes', named_struct('segment', c_mktsegment), 'group_id', concat('g', c_nationkey))"
    return load.load_suite(spark, _document(spark, sf, "native", one, '{"models": ["A", "B"], "examples": [', "]}"))


@query("load_native", "SELECT 'score' AS metric, CAST(c_custkey AS VARCHAR) AS example_id, 'A' AS model, round(c_acctbal, 6) AS score FROM customer UNION ALL SELECT 'score', CAST(c_custkey AS VARCHAR), 'B', CAST(c_nationkey AS DOUBLE) FROM customer")
def load_native(spark, sf):
    return _cells(_native(spark, sf))


@query("load_native_runs", "SELECT CAST(c_custkey AS VARCHAR) AS example_id, 'A' AS model, CAST(i AS INTEGER) AS run_idx, round(c_acctbal + i, 6) AS score FROM customer, range(2) r(i) UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'B', CAST(i AS INTEGER), CAST(c_nationkey AS DOUBLE) FROM customer, range(2) r(i)")
def load_native_runs(spark, sf):
    return _native(spark, sf).runs.select("example_id", "model", "run_idx", *r6("score"))


@query("load_native_judges", """SELECT CAST(c_custkey AS VARCHAR) AS example_id, 'gold' AS judge, 'A' AS model, 1.0 AS score FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'gold', 'B', c_nationkey % 2 FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'other', 'A', c_nationkey % 2 FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'other', 'B', 1.0 FROM customer""".replace("c_nationkey % 2 FROM", "CAST(c_nationkey % 2 AS DOUBLE) FROM").replace("1.0 FROM", "CAST(1 AS DOUBLE) FROM").replace("1.0 AS", "CAST(1 AS DOUBLE) AS"))  # fmt: skip
def load_native_judges(spark, sf):
    return _native(spark, sf).judges.select("example_id", "judge", "model", "score")


@query("load_native_tags", "SELECT CAST(c_custkey AS VARCHAR) AS example_id, 'segment' AS attr, c_mktsegment AS value, 'g' || c_nationkey AS group_id FROM customer")
def load_native_tags(spark, sf):
    data = _native(spark, sf)
    return data.attributes.join(data.groups, "example_id").select("example_id", "attr", "value", "group_id")


# logs with one event a line


@query("load_lm_eval", "SELECT 'acc' AS metric, CAST(c_custkey AS VARCHAR) AS example_id, 'task' AS model, round(c_acctbal, 6) AS score FROM customer UNION ALL SELECT 'norm', CAST(c_custkey AS VARCHAR), 'task', CAST(c_nationkey AS DOUBLE) FROM customer")
def load_lm_eval(spark, sf):
    return _cells(load.load_suite(spark, _lines(spark, sf, "samples_task_2026-01-02T03-04-05.6", "to_json(named_struct('doc_id', c_custkey, 'resps', array(), 'metrics', array('acc', 'norm'), 'acc', c_acctbal, 'norm', c_nationkey))")))


@query("load_openai_evals", "SELECT 'accuracy' AS metric, 's' || c_custkey AS example_id, 'tested' AS model, CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM customer")
def load_openai_evals(spark, sf):
    spec = "CASE WHEN c_custkey = 0 THEN to_json(named_struct('spec', named_struct('completion_fns', array('tested')))) END"
    event = "to_json(named_struct('type', 'match', 'sample_id', concat('s', c_custkey), 'data', named_struct('correct', c_acctbal > 0)))"
    return _cells(load.load_suite(spark, _lines(spark, sf, "events", spec, event, "to_json(named_struct('type', 'raw', 'sample_id', concat('s', c_custkey)))")))


# totals of runs, texts, pairs of files


@query("load_run_totals", "SELECT 'm' || (c_nationkey % 2) AS model, count(*) AS n, round(avg(c_acctbal), 4) AS mean_score FROM customer GROUP BY 1")
def load_run_totals(spark, sf):
    runs, _, _ = load.load_run_level(spark, _csv(spark, sf, "totals", "concat('m', c_nationkey % 2) AS model", "c_acctbal AS score"), "m0", "m1")
    return runs.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("load_run_columns", "SELECT 'first' AS model, count(*) AS n, round(avg(c_acctbal), 4) AS mean_score FROM customer UNION ALL SELECT 'second', count(*), round(avg(c_nationkey), 4) FROM customer")
def load_run_columns(spark, sf):
    runs, _, _ = load.load_run_level(spark, _csv(spark, sf, "columns", "c_custkey AS run", "c_acctbal AS first", "c_nationkey AS second"))
    return runs.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("load_texts", "SELECT text, count(*) AS n FROM benchmark GROUP BY text")
def load_texts(spark, sf):
    path = f"{folder(spark, 'texts')}/texts.jsonl"
    table(spark, sf, "benchmark").select(F.to_json(F.struct("item_id", "text"))).write.text(path)
    return load.load_texts(spark, path)[0].groupBy("text").agg(F.count("*").alias("n"))


@query("load_pair_of_files", "SELECT CAST(c_custkey AS VARCHAR) AS example_id, 'one' AS model, round(c_acctbal, 6) AS score FROM customer WHERE c_nationkey < 20 AND c_nationkey > 4 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'two', CAST(c_nationkey AS DOUBLE) FROM customer WHERE c_nationkey < 20 AND c_nationkey > 4")
def load_pair_of_files(spark, sf):
    """Two files of one model each; examples that both have."""
    paths = []
    for name, column, keep in (("one", "c_acctbal", "c_nationkey < 20"), ("two", "c_nationkey", "c_nationkey > 4")):
        paths.append(f"{folder(spark, name)}/{name}.csv")
        _customers(spark, sf).where(keep).selectExpr("c_custkey AS id", f"'{name}' AS model", f"{column} AS score").write.csv(paths[-1], header=True)
    return load.load_comparison(spark, *paths).cells.select("example_id", "model", *r6("score"))


# scores that keep arriving


@query("streamed_totals", f"WITH {CELLS} SELECT example_id, model, round(score, 6) AS score FROM cells")
def streamed_totals(spark, sf):
    """Score totals of all lines as a stream of files brings them."""
    at = folder(spark, "stream")
    lines = table(spark, sf, "lineitem").select(F.lit("discount").alias("metric"), F.col("l_partkey").alias("example_id"), F.col("l_returnflag").alias("model"), F.col("l_discount").alias("score"), F.monotonically_increasing_id().alias("row_ord"))
    lines.repartition(4).write.parquet(f"{at}/in")
    totals = ScoreTotals(spark, f"{at}/totals")
    totals.start(spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in"), f"{at}/checkpoint").awaitTermination()
    return totals.cells().select("example_id", "model", *r6("score"))


@query("windowed_means", "SELECT event_type AS metric, user_id % 3 AS model, round(avg(value), 6) AS mean_score, count(value) AS n FROM events GROUP BY event_type, user_id % 3, date_trunc('hour', ts)")
def windowed(spark, sf):
    records = table(spark, sf, "events").select("ts", F.col("event_type").alias("metric"), (F.col("user_id") % 3).alias("model"), F.col("value").alias("score"))
    return windowed_means(records, "ts", "1 hour", "10 minutes").select("metric", "model", *r6("mean_score"), "n")
