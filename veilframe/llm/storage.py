"""Working tables in the folder all executors share."""

from __future__ import annotations

import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from veilframe.session import shared_folder


class Workspace:
    """A folder of its own below the shared one, for the tables of one operator call.

    A stored table survives lost executors and cuts the plan in two. ``drop`` removes a
    table that nothing reads any more; what the result still needs stays until the
    cluster's own clean-up of the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0

    def store(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """The table written and read again; ``by`` deals it into folders by a column."""
        self._made += 1
        path = f"{self.root}/{self._made}"
        if by is None:
            df.write.parquet(path)
        else:
            df.repartition(by).write.partitionBy(by).parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        stored._workspace_path = path
        return stored

    def read_all(self, stored: Sequence[DataFrame]) -> DataFrame:
        """Tables of one schema as one scan."""
        return self.spark.read.schema(stored[0].schema).parquet(*[s._workspace_path for s in stored])

    def drop(self, stored: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(stored._workspace_path)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.delete(path, True)
