"""Columns that turn raw fields into scores, labels and comparable texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS = tuple("1 accept correct good pass passed positive success t true win won y yes".split())
FALSE_WORDS = tuple("0 bad f fail failed failure false incorrect loss lost n negative no reject".split())
_DIGITS = r"[0-9](?:_?[0-9])*"
NUMBER = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
SPECIAL = r"^[+-]?(?:inf|infinity|nan)$"


def number(text: Column) -> Column:
    """A double where the text is a decimal number as scripting languages write one
    (digit groups by single underscores, nan and infinities), else null."""
    t = F.lower(F.trim(text))
    sign = F.when(t.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    special = F.when(t.endswith("nan"), F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
    return F.when(t.rlike(NUMBER), F.regexp_replace(t, "_", "").try_cast("double")).when(t.rlike(SPECIAL), special)


def coerce_score(raw: Column) -> Column:
    """Score of a text field: a number, a percentage, or a word of success or failure; null
    where it is none of them."""
    t = F.lower(F.trim(raw))
    percent = number(F.regexp_replace(t, r"%$", "")) / F.lit(100.0)
    return (
        F.when(t.endswith("%"), percent)
        .when(number(t).isNotNull(), number(t))
        .when(t.isin(*TRUE_WORDS), F.lit(1.0))
        .when(t.isin(*FALSE_WORDS), F.lit(0.0))
    )


def normal_text(text: Column) -> Column:
    """Lower case, without punctuation, single blanks: the form in which texts are compared."""
    bare = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def _steps(value: Column, edges: tuple[float, float, float]) -> Column:
    v = F.abs(value)
    return F.when(v < edges[0], "negligible").when(v < edges[1], "small").when(v < edges[2], "medium").otherwise("large")


#: Upper edges of negligible, small and medium, by kind of effect.
EDGES = {"d": (0.2, 0.5, 0.8), "h": (0.2, 0.5, 0.8), "r": (0.1, 0.3, 0.5), "g": (0.05, 0.15, 0.25), "cles": (0.06, 0.14, 0.21)}


def magnitude(value: Column, kind: str) -> Column:
    return _steps(value, EDGES[kind])


def magnitude_of(value: float, kind: str) -> str:
    v = abs(value)
    return next((name for name, edge in zip(("negligible", "small", "medium"), EDGES[kind]) if v < edge), "large")


def cohens_h(p: Column, q: Column) -> Column:
    return 2 * F.asin(F.sqrt(p)) - 2 * F.asin(F.sqrt(q))


def exact_two_sided(k: Column, n: Column) -> Column:
    """Two-sided p of k successes in n fair trials, as a sum of logarithms in SQL."""
    least = F.least(k, n - k).cast("long")
    logs = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.greatest(least, F.lit(0).cast("long"))),
        F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("t")),
        lambda acc, i: F.struct(
            F.when(i == 0, F.lit(0.0)).otherwise(acc["c"] + F.ln((n - i + 1).cast("double")) - F.ln(F.greatest(i, F.lit(1)).cast("double"))).alias("c"),
            (acc["t"] + F.exp(F.when(i == 0, F.lit(0.0)).otherwise(acc["c"] + F.ln((n - i + 1).cast("double")) - F.ln(F.greatest(i, F.lit(1)).cast("double"))) - n * F.ln(F.lit(2.0)))).alias("t"),
        ),
        lambda acc: acc["t"],
    )
    return F.when((n == 0) | (2 * least == n), F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * logs))
