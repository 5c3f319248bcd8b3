"""Working tables of one call, in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veilframe.session import shared_folder
from veilframe.sources.commits import Folder


class Scratch:
    """A folder of its own. A stored table survives lost executors, is computed once however
    often it is read, and cuts the plan in two. ``drop`` removes what nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self._spark = spark
        self._root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0

    def store(self, df: DataFrame) -> DataFrame:
        self._made += 1
        path = f"{self._root}/{self._made}"
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self, number: int) -> None:
        Folder(self._spark, self._root).delete(str(number))
