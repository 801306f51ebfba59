"""Exports of evaluation tools, told apart by their structure.

Each adapter turns JSON text into raw records (metric, example_id, model, judge, raw,
row_ord, counted) with expressions that run in the scan; ``raw`` is the score as text, and
``counted`` says whether an unreadable one is reported as skipped. Detection looks at the
document's outline (``rows.outline``), which has an element of every structure in a list.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import coerce_score
from .roles import extract
from .rows import LIST_WRAPPERS, elements, settled

RAW = ["metric", "example_id", "model", "judge", "raw", "row_ord", "counted"]


def at(path: str, column: str = "row") -> Column:
    return F.get_json_object(column, path)


def _raw(rows: DataFrame, metric: Column, example: Column, model: Column, raw: Column, counted: Column | None = None) -> DataFrame:
    return rows.select(metric.alias("metric"), example.alias("example_id"), model.alias("model"), F.lit(None).cast("string").alias("judge"), raw.cast("string").alias("raw"), "row_ord", (F.lit(True) if counted is None else counted).alias("counted"))


def _of(doc: DataFrame, *keys: str) -> DataFrame:
    """Rows of the first of several lists in a document; the document's own if it is a list."""
    return elements(doc.select(F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in keys], F.col("value")).alias("value")))


def _place() -> Column:
    return F.col("row_ord").cast("string")


def _mean_of(texts: Column) -> Column:
    """Mean of the readable scores of an array of texts; null without any."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    add = lambda a, x: F.when(x.isNull(), a).otherwise(F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")))
    return F.aggregate(F.transform(texts, coerce_score), start, add, lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))


@dataclass(frozen=True)
class Adapter:
    name: str
    detect: Callable[[object], bool]
    parse: Callable[[DataFrame], DataFrame]
    #: Metrics to prefer where a single one is audited.
    primary: tuple[str, ...] = ()


def _rows(raw) -> list:
    return raw if isinstance(raw, list) else []


def _first(rows) -> dict:
    return rows[0] if rows and isinstance(rows[0], dict) else {}


# one tool after the other


def _promptfoo_rows(raw):
    raw = raw if isinstance(raw, dict) else {}
    for _ in range(2):  # the list is one or two levels down
        raw = raw.get("results", []) if isinstance(raw, dict) else raw if isinstance(raw, list) else []
    return raw if isinstance(raw, list) else []


def promptfoo(doc: DataFrame) -> DataFrame:
    rows = _of(doc, "results.results", "results")
    model = F.coalesce(at("$.provider.id"), at("$.provider.label"), at("$.provider"))
    example = F.coalesce(at("$.testIdx"), at("$.test_idx"), _place())
    score = F.coalesce(at("$.score"), at("$.success"))
    found = _raw(rows, F.lit("score"), example, model, score).where("raw IS NOT NULL")
    return found.withColumn("raw", F.when(coerce_score(F.col("raw")).isNull(), F.raise_error(F.concat(F.lit("unreadable score "), "raw"))).otherwise(F.col("raw")))


def _deepeval_rows(raw):
    return next((raw[k] for k in ("test_results", "testCases", "test_cases") if isinstance(raw, dict) and isinstance(raw.get(k), list)), [])


def deepeval(doc: DataFrame) -> DataFrame:
    model = doc.select(F.coalesce(F.get_json_object("value", "$.hyperparameters.model"), F.lit("model")).alias("m"))
    rows = _of(doc, "test_results", "testCases", "test_cases").join(F.broadcast(model))
    inner = F.from_json(F.coalesce(at("$.metrics_data"), at("$.metricsData")), "array<struct<score:string>>")
    score = F.coalesce(at("$.success"), _mean_of(F.transform(inner, lambda x: x["score"])).cast("string"))
    checked = F.when(score.isNull(), F.raise_error(F.lit("a test case has no score"))).otherwise(score)
    return _raw(rows, F.lit("score"), F.coalesce(at("$.name"), _place()), F.col("m"), checked)


def openevals(doc: DataFrame) -> DataFrame:
    example = F.coalesce(*[at(f"$.{k}") for k in "id example_id test_id case_id index idx".split()], _place())
    return _raw(elements(doc), F.coalesce(at("$.key"), F.lit("score")), example, F.lit("model"), at("$.score"))


def _inspect_detect(raw) -> bool:
    """A log has a model, and a sample with a score that is an object with a value."""
    if not isinstance(raw, dict) or "model" not in (raw.get("eval") or {}):
        return False
    scores = [s.get("scores") for s in raw.get("samples") or [] if isinstance(s, dict)]
    return any("value" in v for x in scores if isinstance(x, dict) for v in x.values() if isinstance(v, dict))


def inspect(doc: DataFrame) -> DataFrame:
    model = doc.select(F.coalesce(F.get_json_object("value", "$.eval.model"), F.lit("model")).alias("m"))
    rows = _of(doc, "samples").join(F.broadcast(model))
    scores = F.map_entries(F.from_json(at("$.scores"), "map<string,struct<value:string>>"))
    one = rows.select("row_ord", "m", F.coalesce(at("$.id"), _place()).alias("e"), F.explode_outer(scores).alias("s"))
    value = F.col("s.value.value")
    graded = F.when(value == "C", "1").when(value == "I", "0").when(value == "P", "0.5").when(value == "N", "0").otherwise(value)
    return _raw(one, F.coalesce("s.key", F.lit("score")), F.col("e"), F.col("m"), graded)


_LANGFUSE_TYPES = ("NUMERIC", "BOOLEAN", "CATEGORICAL")


def _langfuse_row(r) -> bool:
    if not (isinstance(r, dict) and isinstance(r.get("name"), str) and ("value" in r or "stringValue" in r)):
        return False
    return "traceId" in r or isinstance(r.get("subject"), dict) or ("dataType" in r and {"id", "projectId", "source"} <= set(r))


def langfuse(doc: DataFrame) -> DataFrame:
    meta = doc.select(F.get_json_object("value", "$.meta.cursor").alias("c"), F.get_json_object("value", "$.meta.page").alias("p"), F.get_json_object("value", "$.meta.totalPages").alias("t")).first()
    if meta and (meta["c"] or (meta["p"] and meta["t"] and (meta["p"], meta["t"]) != ("1", "1"))):
        raise ValueError("this is one page of several; join the data of all pages in one list first")
    rows = _of(doc, "data")
    kind = at("$.subject.kind")
    trace = F.coalesce(F.nullif(at("$.traceId"), F.lit("")), F.when(kind == "trace", at("$.subject.id")).when(kind == "observation", at("$.subject.traceId")))
    typed = F.upper(F.coalesce(at("$.dataType"), F.lit("")))
    newer = at("$.projectId").isNotNull() | at("$.subject").isNotNull() | (at("$.traceId").isNull() & at("$.sessionId").isNull() & at("$.observationId").isNull())
    value = F.when((typed == "CATEGORICAL") & ~newer & at("$.configId").isNull(), at("$.stringValue")).otherwise(at("$.value"))
    usable = typed.isin("", *_LANGFUSE_TYPES) & trace.isNotNull() & at("$.name").isNotNull()
    found = _raw(rows, F.coalesce(at("$.name"), F.lit("score")), F.coalesce(trace, _place()), F.lit("model"), F.when(usable, value))
    twice = found.where(coerce_score(F.col("raw")).isNotNull()).groupBy("example_id", "metric").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"trace {twice[0]['example_id']!r} has several scores named {twice[0]['metric']!r}; keep one")
    return found


def langsmith(doc: DataFrame) -> DataFrame:
    rows = elements(doc).where(at("$.reference_example_id").isNotNull())
    averages = F.transform(F.map_values(F.from_json(at("$.feedback_stats"), "map<string,struct<avg:string>>")), lambda x: x["avg"])
    return _raw(rows, F.lit("score"), at("$.reference_example_id"), F.lit("model"), _mean_of(averages))


RAGAS_INPUTS = set("answer contexts ground_truth ground_truths id question reference reference_contexts response retrieved_contexts user_input".split())
RAGAS_METRICS = tuple(sorted(
    "answer_correctness answer_relevancy answer_similarity bleu_score coherence conciseness context_entity_recall context_precision context_recall context_relevancy context_utilization".split()
    + "exact_match factual_correctness faithfulness harmfulness maliciousness noise_sensitivity_irrelevant noise_sensitivity_relevant rouge_score semantic_similarity string_present summarization_score".split()
))


def ragas(doc: DataFrame) -> DataFrame:
    fields = elements(doc).select("row_ord", F.json_tuple("row", *RAGAS_METRICS).alias(*RAGAS_METRICS))  # an element is parsed once
    return _raw(fields, F.lit("score"), _place(), F.lit("model"), _mean_of(F.array(*RAGAS_METRICS)))


HELM_BOOKKEEPING = tuple("num_completions num_instances num_output_tokens num_prompt_tokens num_references num_train_instances num_trials prompt_truncated".split())


def helm(doc: DataFrame) -> DataFrame:
    stats = F.from_json(at("$.stats"), "array<struct<name:struct<name:string>,mean:string>>")
    one = elements(doc).select("row_ord", F.coalesce(at("$.instance_id"), _place()).alias("e"), F.explode(stats).alias("s")).where("s.name.name IS NOT NULL")
    return _raw(one, F.col("s.name.name"), F.col("e"), F.lit("model"), F.col("s.mean"))


def quality_only(raw: DataFrame) -> DataFrame:
    """Without bookkeeping statistics, as a suite wants it."""
    return raw.where(~F.col("metric").isin(*HELM_BOOKKEEPING) & ~F.col("metric").startswith("finish_reason_"))


def _split_table(raw):
    t = raw.get("eval_results_table", raw) if isinstance(raw, dict) else None
    return t if isinstance(t, (dict, list)) else None


def _mlflow_columns(raw) -> list[str]:
    t = _split_table(raw)
    names = t.get("columns") if isinstance(t, dict) else list(t[0]) if isinstance(t, list) and t and isinstance(t[0], dict) else None
    names = [c for c in names or [] if isinstance(c, str)]
    return [c for c in names if re.fullmatch(r".+/score", c) or c in ("token_count", "latency")]


def mlflow(doc: DataFrame) -> DataFrame:
    inner = doc.select(F.coalesce(F.get_json_object("value", "$.eval_results_table"), F.col("value")).alias("value"))
    table = inner.select(F.from_json(F.get_json_object("value", "$.columns"), "array<string>").alias("c"), F.from_json(F.get_json_object("value", "$.data"), "array<array<string>>").alias("d"))
    split = settled(table.where("c IS NOT NULL").select("c", F.posexplode("d").alias("row_ord", "v")).withColumn("row_ord", F.col("row_ord").cast("long")))
    split = split.select("row_ord", F.inline(F.arrays_zip(F.col("c").alias("c"), F.col("v").alias("v"))))
    listed = elements(inner).select("row_ord", F.explode(F.map_entries(F.from_json("row", "map<string,string>"))).alias("e")).select("row_ord", F.col("e.key").alias("c"), F.col("e.value").alias("v"))
    cells = split.unionByName(listed)
    metric = F.when(F.col("c").rlike("^.+/score$"), F.regexp_extract("c", "^(.+)/score$", 1)).when(F.col("c").isin("token_count", "latency"), F.col("c"))
    return _raw(cells.where(metric.isNotNull()), metric, _place(), F.lit("model"), F.col("v"))


def _lighteval_row(r) -> bool:
    if not isinstance(r, dict):
        return False
    doc, metric = r.get("doc", r.get("__doc__")), r.get("metric", r.get("__metric__"))
    return isinstance(doc, dict) and isinstance(metric, dict) and {"query", "choices", "gold_index"} <= set(doc)


def _lighteval_detect(raw) -> bool:
    if isinstance(raw, dict) and isinstance(raw.get("config_general"), dict) and "lighteval_sha" in raw["config_general"]:
        raise ValueError("these are totals over tasks; an audit needs the per-sample details")
    return any(_lighteval_row(r) for r in _rows(raw))


def lighteval(doc: DataFrame) -> DataFrame:
    rows = elements(doc)
    differ = lambda a, b: at(a).isNotNull() & at(b).isNotNull() & (at(a) != at(b))
    d, m = F.coalesce(at("$.doc"), at("$.__doc__")), F.coalesce(at("$.metric"), at("$.__metric__"))
    parts = rows.select("row_ord", (differ("$.doc", "$.__doc__") | differ("$.metric", "$.__metric__")).alias("bad"), d.alias("d"), F.from_json(m, "map<string,string>").alias("m"))
    inner = lambda k: F.get_json_object("d", f"$.{k}")
    usable = ~F.col("bad") & inner("query").isNotNull() & inner("choices").isNotNull() & inner("gold_index").isNotNull() & inner("id").isNotNull()
    example = F.concat_ws(":", F.nullif(inner("task_name"), F.lit("")), inner("id"))
    good = F.filter(F.map_entries("m"), lambda e: ~e["key"].endswith("_stderr") & coerce_score(e["value"]).isNotNull())
    scores = F.when(usable & (F.size(good) > 0), good)
    one = parts.select("row_ord", example.alias("e"), F.explode_outer(scores).alias("s"))
    return _raw(one, F.coalesce("s.key", F.lit("score")), F.col("e"), F.lit("model"), F.col("s.value"))


def native(doc: DataFrame) -> DataFrame:
    return native_scores(native_examples(doc))


def native_examples(doc: DataFrame) -> DataFrame:
    return _of(doc, "examples")


def native_scores(rows: DataFrame) -> DataFrame:
    """Plain scores; runs, judges, preferences, attributes and groups come from ``native_parts``."""
    one = rows.select("row_ord", F.coalesce(at("$.id"), _place()).alias("e"), F.explode(F.map_entries(F.from_json(at("$.scores"), "map<string,string>"))).alias("s"))
    return _raw(one, F.lit("score"), F.col("e"), F.col("s.key"), F.col("s.value"))


def native_parts(rows: DataFrame) -> dict[str, DataFrame]:
    """Tables of the nested form beside its scores. A run list with one unreadable value is
    left out, of judges only the unreadable cell."""
    rows = rows.select("row_ord", F.coalesce(at("$.id"), _place()).alias("example_id"), "row")
    entry = lambda path, kind: F.explode(F.map_entries(F.from_json(at(path), kind)))
    runs = rows.select("example_id", entry("$.runs", "map<string,array<string>>").alias("r")).withColumn("v", F.transform("r.value", coerce_score)).where("forall(v, x -> x IS NOT NULL)")
    runs = runs.select(F.lit("score").alias("metric"), "example_id", F.col("r.key").alias("model"), F.posexplode("v").alias("run_idx", "score"))
    judged = rows.select("example_id", "row_ord", entry("$.judges", "map<string,map<string,string>>").alias("j")).select("example_id", "row_ord", F.col("j.key").alias("judge"), F.explode(F.map_entries("j.value")).alias("s"))
    judged = judged.select(F.lit("score").alias("metric"), "example_id", F.col("s.key").alias("model"), "judge", coerce_score(F.col("s.value")).alias("score"), F.col("row_ord").alias("judge_ord")).where("score IS NOT NULL")
    prefs = rows.select("example_id", "row_ord", entry("$.preferences", "map<string,string>").alias("p"))
    value = F.trim("p.value")
    prefs = prefs.select(F.lit("score").alias("metric"), "example_id", F.col("p.key").alias("judge"), F.when(F.lower(value) != "tie", value).alias("winner"), (F.lower(value) == "tie").alias("is_tie"), "row_ord")
    tags = rows.select("example_id", entry("$.attributes", "map<string,string>").alias("a")).select("example_id", F.col("a.key").alias("attr"), F.col("a.value").alias("value"))
    groups = rows.select("example_id", at("$.group_id").alias("group_id")).where("group_id IS NOT NULL")
    return {"runs": runs, "judges": judged, "preferences": prefs, "attributes": tags, "groups": groups}


def generic(doc: DataFrame) -> DataFrame:
    return extract(_of(doc, *LIST_WRAPPERS))[0]


def _list_of(raw) -> list:
    return raw if isinstance(raw, list) else next((raw[k] for k in LIST_WRAPPERS if isinstance(raw, dict) and isinstance(raw.get(k), list)), [])


#: The first that recognises a document reads it: the most specific come first.
ADAPTERS = (
    Adapter("promptfoo", lambda r: "provider" in _first(_promptfoo_rows(r)), promptfoo),
    Adapter("deepeval", lambda r: bool({"metrics_data", "metricsData"} & set(_first(_deepeval_rows(r)))) or ("success" in _first(_deepeval_rows(r)) and bool({"name", "input"} & set(_first(_deepeval_rows(r))))), deepeval),
    Adapter("openevals", lambda r: {"key", "score"} <= set(_first(_rows(r))), openevals),
    Adapter("inspect", _inspect_detect, inspect),
    Adapter("langfuse", lambda r: any(_langfuse_row(x) for x in (r.get("data") or [] if isinstance(r, dict) and isinstance(r.get("data"), list) else _rows(r))), langfuse),
    Adapter("langsmith", lambda r: {"reference_example_id", "feedback_stats"} <= set(_first(_rows(r))), langsmith),
    Adapter("ragas", lambda r: "model" not in _first(_rows(r)) and bool(RAGAS_INPUTS & set(_first(_rows(r)))) and bool(set(RAGAS_METRICS) & set(_first(_rows(r)))), ragas),
    Adapter("helm", lambda r: any(isinstance(x, dict) and "instance_id" in x and any(isinstance(s, dict) and isinstance(s.get("name"), dict) for s in x.get("stats") or []) for x in _rows(r)[:10]), helm, tuple("exact_match quasi_exact_match f1_score rouge_l bleu_1".split())),
    Adapter("mlflow_evaluate", lambda r: bool(_mlflow_columns(r)), mlflow),
    Adapter("lighteval", _lighteval_detect, lighteval, tuple("acc exact_match em qem pass@1 maj@1".split())),
    Adapter("native", lambda r: isinstance(r, dict) and "scores" in _first(r.get("examples") if isinstance(r.get("examples"), list) else []), native),
    Adapter("generic", lambda r: bool(_first(_list_of(r))), generic),
)


def detect(raw) -> Adapter:
    found = next((a for a in ADAPTERS if a.detect(raw)), None)
    if found is None:
        raise ValueError("no known format has this structure")
    return found


# logs with one event a line

LM_EVAL_RESERVED = set("arguments doc doc_hash doc_id filter filtered_resps metrics model prompt_hash resps target target_hash task_name".split())
_STAMP = re.compile(r"(?P<task>.+)_(?P<stamp>\d{4}-\d\d-\d\dT[\d.:-]+)")


def is_lm_eval(first: dict) -> bool:
    return "doc_id" in first and bool({"resps", "filtered_resps"} & set(first)) and "model" not in first


def lm_eval_model(path: str) -> tuple[str, dict]:
    """The model's name: from the results file of the same time beside the log, or the only
    one there, else from the log's own name."""
    stem = Path(path).stem.removeprefix("samples_")
    m = _STAMP.fullmatch(stem)
    beside = sorted(Path(path).parent.glob("results_*.json"))
    same = [b for b in beside if m and b.stem.removeprefix("results_") == m["stamp"]] or (beside if len(beside) == 1 else [])
    for b in same[:1]:
        try:
            name = json.loads(b.read_text(encoding="utf-8")).get("model_name")
        except (OSError, ValueError, AttributeError):
            name = None
        if isinstance(name, str) and name:
            return name, {"model_name_inferred": False, "model_name_source": b.name}
    return (m["task"] if m else stem), {"model_name_inferred": True}


def lm_eval(rows: DataFrame, model: str) -> DataFrame:
    fields = F.from_json("row", "map<string,string>")
    named = F.from_json(at("$.metrics"), "array<string>")
    keys = F.filter(F.coalesce(named, F.map_keys(fields)), lambda k: ~k.isin(*LM_EVAL_RESERVED))
    one = rows.select("row_ord", at("$.doc_id").alias("e"), fields.alias("f"), F.explode(keys).alias("k"))
    return _raw(one, F.col("k"), F.coalesce("e", _place()), F.lit(model), F.when(F.col("e").isNotNull(), F.element_at("f", F.col("k"))))


def is_openai_evals(rows: DataFrame) -> bool:
    return bool(rows.where(F.from_json(at("$.spec.completion_fns"), "array<string>").isNotNull()).head(1))


def openai_evals(rows: DataFrame) -> DataFrame:
    spec = rows.where(at("$.spec.completion_fns").isNotNull()).agg(F.min(F.struct("row_ord", at("$.spec.completion_fns[0]").alias("m"))).alias("s")).select(F.coalesce("s.m", F.lit("model")).alias("m"))
    good = F.when(at("$.sample_id").isNotNull() & at("$.data.correct").isin("true", "false"), at("$.data.correct"))
    return _raw(rows.where(at("$.type") == "match").join(F.broadcast(spec)), F.lit("accuracy"), F.coalesce(at("$.sample_id"), _place()), F.col("m"), good)
