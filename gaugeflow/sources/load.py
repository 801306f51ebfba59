"""Files to evaluation tables."""

from __future__ import annotations

import json
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import coerce_score
from ..operators.pairing import merge_two
from ..plans.data import EvalFrames, collapse_metrics
from . import adapters, roles, rows

def _frames(raw: DataFrame, prefs: DataFrame | None, name: str, metadata: dict, all_metrics: bool) -> EvalFrames:
    scored = raw.withColumn("score", coerce_score(F.col("raw")))
    counts = scored.agg(F.count_if(F.expr("score IS NULL AND counted")).alias("skipped"), F.count("score").alias("kept")).first()
    if not counts["kept"] and prefs is None:
        raise ValueError(f"no readable score in this {name} file")
    records = scored.where("score IS NOT NULL").select("metric", "example_id", "model", "judge", "score", "row_ord")
    records = records if all_metrics else collapse_metrics(records)
    return EvalFrames.of_records(records, name, preferences=prefs, metadata=metadata | {"skipped_rows": counts["skipped"], "kept": counts["kept"]})


def load_suite(spark: SparkSession, path: str, all_metrics: bool = True) -> EvalFrames:
    """One file, every metric of it (or, without ``all_metrics``, all rows as one metric)."""
    kind = rows.suffix(path)
    if kind == ".jsonl" and rows.begins_with_array(spark, path):
        kind = ".json"
    readers = {".csv": [_csv], ".json": [_document], ".jsonl": [_lines]}.get(kind, [_document, _lines, _csv])
    for i, reader in enumerate(readers):
        try:
            return reader(spark, path, all_metrics)
        except (ValueError, rows.UnknownFormat):
            if i == len(readers) - 1:
                raise
    raise rows.UnknownFormat(path)


def _csv(spark, path, all_metrics):
    return _frames(*roles.extract(rows.csv_rows(spark, path)), "csv", {}, all_metrics)


def _lines(spark, path, all_metrics):
    events = rows.json_lines(spark, path)
    first = events.orderBy("row_ord").limit(1).collect()
    if not first:
        raise rows.UnknownFormat(f"{path} is empty")
    if adapters.is_lm_eval(json.loads(first[0]["row"])):
        model, about = adapters.lm_eval_model(path)
        return _frames(adapters.lm_eval(events, model), None, "lm-eval", about, all_metrics)
    if adapters.is_openai_evals(events):
        return _frames(adapters.openai_evals(events), None, "openai-evals", {}, all_metrics)
    return _frames(*roles.extract(events), "jsonl", {}, all_metrics)


def _document(spark, path, all_metrics):
    doc = rows.document(spark, path)
    found = adapters.detect(rows.peek(doc))
    if found.name == "generic":
        return _frames(*roles.extract(adapters._of(doc, *rows.LIST_WRAPPERS)), "generic", {}, all_metrics)
    examples = adapters.native_examples(doc) if found.name == "native" else None
    raw = found.parse(doc) if examples is None else adapters.native_scores(examples)
    raw = adapters.quality_only(raw) if found.name == "helm" and all_metrics else raw
    if not all_metrics:
        raw = _primary(raw, found)
    frames = _frames(rows.settled(raw), None, found.name, {}, True)
    if examples is None:
        return frames
    parts = adapters.native_parts(examples)
    has = {k: v if v.head(1) else None for k, v in parts.items()}
    declared = doc.select(F.posexplode(F.from_json(F.get_json_object("value", "$.models"), "array<string>")).alias("model_ord", "model")).select(F.lit("score").alias("metric"), "model", "model_ord")
    return replace(frames, models=declared if declared.head(1) else frames.models, **has)


def _primary(raw: DataFrame, adapter: adapters.Adapter) -> DataFrame:
    """The one metric that a single audit takes: a preferred one, else the first (of those
    that measure quality)."""
    order = raw.where(coerce_score(F.col("raw")).isNotNull()).groupBy("metric").agg(F.min("row_ord").alias("o")).orderBy("o", "metric").collect()
    names = [r["metric"] for r in order]
    plain = [n for n in names if n not in ("token_count", "latency")] or names
    best = next((p for p in adapter.primary if p in names), plain[0] if plain else None)
    return raw.where(F.col("metric") == best).withColumn("metric", F.lit("score"))


def load(spark: SparkSession, path: str) -> EvalFrames:
    return load_suite(spark, path, all_metrics=False)


def load_comparison(spark: SparkSession, path_a: str, path_b: str, label_a: str | None = None, label_b: str | None = None) -> EvalFrames:
    """Two files of one model each, paired by example id."""
    one, two = load(spark, path_a), load(spark, path_b)
    labels = []
    for data, path, label in ((one, path_a, label_a), (two, path_b, label_b)):
        names = data.model_names()
        if len(names) != 1:
            raise ValueError(f"{path} has {len(names)} models; a pair of files has one in each")
        labels.append(label or (names[0] if names[0] != "model" else Path(path).stem))
    a, b = labels
    b = f"{b}_2" if a == b else b
    cells = merge_two(one.cells, two.cells, a, b)
    n = [one.cells.select("example_id").distinct().count(), two.cells.select("example_id").distinct().count(), cells.select("example_id").distinct().count()]
    models = cells.sparkSession.createDataFrame([("score", a, 0), ("score", b, 1)], "metric string, model string, model_ord int")
    named = lambda df, label: df.withColumn("model", F.lit(label))
    join = lambda x, y: named(x, a).unionByName(named(y, b)) if x is not None and y is not None else None
    about = {"skipped_rows": one.metadata.get("skipped_rows", 0) + two.metadata.get("skipped_rows", 0), "unmatched_examples": n[0] + n[1] - 2 * n[2], "kept": n[2]}
    return EvalFrames(cells, models, join(one.runs, two.runs), join(one.judges, two.judges), source_format=one.source_format, metadata=about)


RUN_META = set("index iteration run run_id seed trial".split())
RUN_MODEL, RUN_SCORE = ("model", "name", *"provider system variant".split()), tuple("score value result accuracy pass_rate".split())


def load_run_level(spark: SparkSession, path: str, a: str | None = None, b: str | None = None) -> tuple[DataFrame, str, str]:
    """(model, run_ord, score) of two models, and their names. CSV with a column per model
    or with model and score columns; JSON of lists by model, in one object or one a line."""
    if rows.suffix(path) == ".csv":
        table = rows.csv_rows(spark, path)
        columns = rows.columns_of(table)
        m, s = roles.role(columns, RUN_MODEL), roles.role(columns, RUN_SCORE)
        if m and s:
            runs = table.select(roles.field(m).alias("model"), F.col("row_ord").alias("run_ord"), coerce_score(roles.field(s)).alias("score")).where("score IS NOT NULL")
        else:
            names = [c for c in columns if c.lower() not in RUN_META]
            pick = [a, b] if a and b else names[:2]
            both = table.select("row_ord", *[coerce_score(roles.field(c)).alias(c) for c in pick]).dropna()
            runs = both.unpivot(["row_ord"], pick, "model", "score").withColumnRenamed("row_ord", "run_ord").select("model", "run_ord", "score")
    else:
        source = rows.document(spark, path) if rows.suffix(path) == ".json" else rows.json_lines(spark, path).withColumnRenamed("row", "value")
        lists = source.select(F.explode(F.map_entries(F.from_json("value", "map<string,array<string>>"))).alias("e"))
        runs = lists.select(F.col("e.key").alias("model"), F.posexplode("e.value").alias("run_ord", "raw")).withColumn("score", F.when(~F.col("raw").isin("true", "false"), F.col("raw").try_cast("double")))
        bad = runs.where("score IS NULL OR isnan(score) OR abs(score) = double('inf')").limit(1).collect()
        if bad:
            raise ValueError(f"run {bad[0]['run_ord']} of {bad[0]['model']!r} is no finite number")
        runs = runs.select("model", F.col("run_ord").cast("long").alias("run_ord"), "score")
    names = [r["model"] for r in runs.groupBy("model").agg(F.min("run_ord").alias("o")).orderBy("o", "model").collect()]
    a, b = a or names[0], b or next((n for n in names if n != (a or names[0])), None)
    if a not in names or b not in names:
        raise ValueError(f"runs of two models are needed; there are {', '.join(names)}")
    return runs.where(F.col("model").isin(a, b)), a, b


def load_texts(spark: SparkSession, path: str, column: str = "text") -> tuple[DataFrame, int]:
    """(id, text) of a table of texts, and how many rows lack the column."""
    kind = rows.suffix(path)
    if kind == ".csv":
        table = rows.csv_rows(spark, path)
    elif kind == ".jsonl":
        table = rows.json_lines(spark, path)
    else:
        table = adapters._of(rows.document(spark, path), *rows.LIST_WRAPPERS)
    plain = F.when(F.trim("row").startswith("{"), roles.field(column)).otherwise(F.col("row"))
    texts = table.select(F.col("row_ord").alias("id"), plain.alias("text"))
    return texts.where("text IS NOT NULL"), texts.where("text IS NULL").count()
