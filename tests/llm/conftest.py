from __future__ import annotations

import re

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Names the operators use inside, as columns a table may have as well.
CLASHING = ("id", "line", "band", "fingerprint", "component_id", "row", "words", "_id", "_gone", "n_words")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or from (id, text) pairs."""

    def make_documents(texts, extra=False):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
        df = spark.createDataFrame(rows, schema)
        if extra:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)])
        return df

    return make_documents


ODD = [
    None,
    "",
    " \n\t ",
    "one",
    "two words",
    "The quick brown fox jumps over the lazy dog and runs away.\nThe quick brown fox jumps over the lazy dog and runs away.",
    "The quick brown fox jumps over the lazy dog and runs away.\nThe quick brown fox jumps over the lazy dog and runs away.",
    "Été à la plage, où l'œuvre ß straße 東京 🙂\nlonger line with ünïcödé\n",
    "word " * 9000,
]
