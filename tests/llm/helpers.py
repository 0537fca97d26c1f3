"""Small awkward inputs shared by the tests of this folder."""

import pathlib
import random
import re

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType())])


def used_names():
    """Every name in quotes in the operators' modules that could be a column: operators use them inside."""
    found = set()
    for path in (pathlib.Path(__file__).parents[2] / "quarry" / "llm").glob("*.py"):
        if path.name not in ("oracle.py", "__init__.py"):
            found |= {m.lower() for m in re.findall(r"[\"'](_{0,2}[a-zA-Z][a-zA-Z0-9_]{0,20})[\"']", path.read_text())}
    return sorted(found - {f.name for f in DOCS.fields})


CLASH = used_names()


def words(n, seed=0, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def frame(spark, rows):
    """Documents from (doc_id, text) or whole rows."""
    rows = [r if len(r) == 5 else (r[0], r[1], "en", "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(rows, DOCS)


def messy(spark):
    """Nulls in every column, empty, blank, odd and very long texts, repeated ids and rows, clashing columns."""
    long = " ".join(words(60_000, 9, 5000))
    rows = [(1, "plain text about nothing much, really.", "en", "a", 38), (2, None, "en", "a", 5), (3, "", None, "b", 0),
            (None, "text without an id", "en", None, None), (4, " \t\n ", "de", "a", 4), (4, "other text, same id", "de", "a", 19),
            (5, "ünïcödé 漢字 😀 \x00 ñandú", "es", "b", -1), (6, long, "en", "a", len(long)), (7, "?!", "en", "a", 2),
            (8, "same row", "en", "a", 8), (8, "same row", "en", "a", 8), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", *[f"{i} as `{c}`" for i, c in enumerate(CLASH)])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()),
                                                   StructField("toxic", IntegerType())]))
