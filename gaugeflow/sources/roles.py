"""Which column of a table of rows is what, and the records that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import coerce_score
from .rows import columns_of

#: Names of each role, the preferred ones first; case doesn't matter.
ID = tuple("id example_id test_id case_id sample_id item_id testidx test_idx index idx input question prompt test query".split())
MODEL = tuple("model provider system variant candidate engine providerid provider_id model_name system_name hypothesis label name".split())
SCORE = tuple("score pass passed success correct result value metric_score rating grade reward accuracy pass_rate".split())
JUDGE = tuple("judge evaluator grader rater judge_model".split())
PREFERENCE = ("preference", "winner")
METRIC = tuple("metric metric_name criterion dimension check_name aspect task skill".split())


def role(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The column of the best name; of two that differ in case alone the later."""
    own = {c.lower(): c for c in columns}
    return next((own[n] for n in names if n in own), None)


def field(name: str) -> Column:
    """A field of ``row`` as text, null where it is missing or null."""
    return F.element_at(F.from_json("row", "map<string,string>"), F.lit(name)) if any(c in name for c in ".[]'*") else F.get_json_object("row", f"$.{name}")


def _is_preference(rows: DataFrame, name: str) -> bool:
    """The first decisive value in row order: a tie or a text that is no score makes it a
    column of winners, a readable score doesn't."""
    value = field(name)
    decisive = rows.where(value.isNotNull() & (F.trim(value) != "")).select((coerce_score(value).isNull() | (F.lower(F.trim(value)) == "tie")).alias("p"), "row_ord")
    first = decisive.orderBy("row_ord").limit(1).collect()
    return bool(first) and first[0]["p"]


def extract(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Raw records (metric, example_id, model, judge, raw, row_ord, counted) and, if there
    is a column of winners, preferences. Long tables have a model and a score column; in
    wide ones every other field of a row is a model, also one that the first row, which
    tells the roles, doesn't have. ``counted`` says whether an unreadable value is reported
    as a skipped row: in wide tables it isn't."""
    columns = columns_of(rows)
    i, m, s, j, k, p = (role(columns, r) for r in (ID, MODEL, SCORE, JUDGE, METRIC, PREFERENCE))
    metric = F.coalesce(field(k), F.lit("score")) if k else F.lit("score")
    example = F.coalesce(field(i), F.col("row_ord").cast("string")) if i else F.col("row_ord").cast("string")
    judge = field(j) if j else F.lit(None).cast("string")
    p = p if p and _is_preference(rows, p) else None
    if m and s and m != s:
        raw = rows.select(metric.alias("metric"), example.alias("example_id"), field(m).alias("model"), judge.alias("judge"), field(s).alias("raw"), "row_ord", F.lit(True).alias("counted"))
    else:
        taken = [c for c in {i, j, k, p} if c]
        fields = F.posexplode(F.map_entries(F.from_json("row", "map<string,string>")))
        each = rows.select(metric.alias("metric"), example.alias("example_id"), judge.alias("judge"), "row_ord", fields.alias("place", "f"))
        each = each.where(~F.col("f.key").isin(taken) & F.col("f.value").isNotNull()) if taken else each.where("f.value IS NOT NULL")
        # models in the order of their columns, rows in theirs
        raw = each.select("metric", "example_id", F.col("f.key").alias("model"), "judge", F.col("f.value").alias("raw"), (F.col("row_ord") * 1024 + F.least("place", F.lit(1023))).alias("row_ord"), F.lit(False).alias("counted"))
    prefs = None
    if p:
        value = F.trim(field(p))
        named = rows.where(field(p).isNotNull()).select(metric.alias("metric"), example.alias("example_id"), F.coalesce(judge, F.lit("default")).alias("judge"), F.when(F.lower(value) != "tie", value).alias("winner"), (F.lower(value) == "tie").alias("is_tie"), "row_ord")
        known = raw.where(coerce_score(F.col("raw")).isNotNull()).select("model").distinct()
        if known.where("lower(model) = 'tie'").head(1):
            raise ValueError("a model is named 'tie', so ties can't be told from wins")
        if known.head(1):
            odd = named.where("winner IS NOT NULL").join(known, named["winner"] == known["model"], "left_anti").limit(1).collect()
            if odd:
                raise ValueError(f"the winner {odd[0]['winner']!r} is no model of the file")
        prefs = named
    return raw, prefs
