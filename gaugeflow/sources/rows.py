"""Files as rows of JSON text: (row_ord, row). CSV lines become objects of strings."""

from __future__ import annotations

import json
import re
from pathlib import PurePath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import folder

LIST_WRAPPERS = tuple("results data rows outputs samples records predictions evaluations".split())


class UnknownFormat(ValueError):
    """No reader takes the file."""


def document(spark: SparkSession, path: str) -> DataFrame:
    """The whole file as one value (a JSON document is one record)."""
    return spark.read.text(path, wholetext=True)


def settled(table: DataFrame) -> DataFrame:
    """``table`` written once and spread by ``row_ord``: what comes out of a document, which is
    one record, is read from it once only and worked on by all tasks."""
    spark = table.sparkSession
    path = f"{folder(spark, 'elements')}/all"
    table.repartition(2 * spark.sparkContext.defaultParallelism, "row_ord").write.parquet(path)
    return spark.read.parquet(path)


def elements(doc: DataFrame, column: str = "value") -> DataFrame:
    """The elements of a JSON array, each as JSON text."""
    found = doc.select(F.posexplode(F.from_json(column, "array<string>")).alias("row_ord", "row"))
    return settled(found.select(F.col("row_ord").cast("long").alias("row_ord"), "row"))


_BLANK = re.compile(r"[ \t\n\r]*")
KEPT = 10


def shape(value) -> object:
    """The structure of a JSON value without its scalars: names and kinds."""
    if isinstance(value, dict):
        return tuple(sorted((k, shape(v)) for k, v in value.items()))
    if isinstance(value, list):
        return frozenset(map(shape, value))
    return type(value).__name__


def outline(text: str):
    """A JSON document whose lists, down to the first ones inside of objects, have the
    elements with which a new structure first comes up, and the first ten in any case. Of a
    list one element is read at a time. What depends on the presence and kind of fields
    anywhere in such a list can be told from the outline as from the whole."""
    scan, skip = json.JSONDecoder().raw_decode, lambda i: _BLANK.match(text, i).end()

    def fail(i: int):
        raise json.JSONDecodeError("not a JSON document", text, i)

    def members(i: int, end: str, one):
        """Positions behind each element of a list or object that begins before ``i``."""
        i = skip(i)
        if text[i : i + 1] == end:
            return i + 1
        while True:
            i = skip(one(skip(i)))
            c = text[i : i + 1]
            if c == end:
                return i + 1
            if c != ",":
                fail(i)
            i += 1

    def read(i: int):
        c = text[i : i + 1]
        if c == "{":
            found: dict = {}

            def field(i: int) -> int:
                if text[i : i + 1] != '"':
                    fail(i)
                key, i = scan(text, i)
                i = skip(i)
                if text[i : i + 1] != ":":
                    fail(i)
                found[key], i = read(skip(i + 1))
                return i

            return found, members(i + 1, "}", field)
        if c == "[":
            kept, seen = [], set()

            def element(i: int) -> int:
                value, i = scan(text, i)
                known = shape(value)
                if len(kept) < KEPT or known not in seen:
                    kept.append(value)
                seen.add(known)
                return i

            return kept, members(i + 1, "]", element)
        return scan(text, i)

    try:
        value, i = read(skip(0))
    except (StopIteration, RecursionError) as e:
        raise json.JSONDecodeError("not a JSON document", text, 0) from e
    if skip(i) != len(text):
        fail(i)
    return value


def peek(doc: DataFrame):
    """The outline of a document, taken where the document is."""

    def scan(batches):
        for b in batches:
            for text in b["value"].to_pylist():
                try:
                    found = json.dumps(outline(text))
                except ValueError as e:
                    found = f"!{e}"
                yield pa.RecordBatch.from_arrays([pa.array([found])], names=["v"])

    rows = doc.select("value").mapInArrow(scan, "v string").collect()
    if not rows or rows[0]["v"].startswith("!"):
        raise ValueError(rows[0]["v"][1:] if rows else "there is no document")
    return json.loads(rows[0]["v"])


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank; a line that isn't a JSON object is an error with its number.
    Only line feeds and carriage returns end a line."""
    # the ids follow the order of the file only directly after its scan
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("row_ord"), F.explode(F.split("value", "\r")).alias("row")).where(r"row RLIKE '\\S'")
    bad = raw.where(F.try_parse_json("row").isNull() | ~F.trim("row").startswith("{")).orderBy("row_ord").limit(1).collect()
    if bad:
        number = raw.where(F.col("row_ord") <= bad[0]["row_ord"]).count()
        raise UnknownFormat(f"line {number} of {path} is not a JSON object")
    return raw


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A file is split between tasks unless a quoted field runs over the end of a line,
    which an odd number of quotes in some line gives away."""
    odd = spark.read.text(path).where(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1)
    table = spark.read.csv(path, header=True, inferSchema=False, multiLine=bool(odd.head(1)), escape='"')
    if not table.head(1):
        raise UnknownFormat(f"{path} has no rows")
    return table.select(F.monotonically_increasing_id().alias("row_ord"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])).alias("row"))


def columns_of(rows: DataFrame) -> list[str]:
    """Names in the first row, in order."""
    first = rows.orderBy("row_ord").limit(1).collect()
    return list(json.loads(first[0]["row"])) if first else []


def suffix(path: str) -> str:
    return PurePath(path).suffix.lower()


def begins_with_array(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).where(r"value RLIKE '\\S'").limit(1).collect()
    return bool(first) and first[0]["value"].lstrip().startswith("[")
