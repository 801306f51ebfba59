"""Random draws that don't depend on partitions, engines or the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _word(*parts: Column) -> Column:
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def draw_index(seed: int, replicate: Column, slot: Column, size: Column) -> Column:
    """Uniform 0 .. size - 1 for a slot of a replicate."""
    return F.pmod(_word(F.lit(seed), replicate, slot), size)


def draw_sign(seed: int, replicate: Column, slot: Column) -> Column:
    return F.when(F.pmod(_word(F.lit(seed), replicate, slot), F.lit(2)) == 0, F.lit(1)).otherwise(F.lit(-1))


def sql_word(*parts: str) -> str:
    """The same draw in DuckDB."""
    return "CAST(('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8)) AS BIGINT)"
