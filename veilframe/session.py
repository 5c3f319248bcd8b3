"""Session settings and the shared folder that jobs may write working data to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import cache

from pyspark.sql import SparkSession

# A salt is a literal at the head of a concatenation; this hides it in printed plans.
SALT_REDACTION = r"(?<=concat\()[^,]*_(?=, )"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Join by hashing instead of sorting where every partition turned out this small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.redaction.string.regex": SALT_REDACTION,
}

# For the session builder only: recording the Python call site of every column takes
# longer than building the plan.
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the library relies on to a session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="veilframe-")
    # It may hold raw cells, so it goes with the process that made it.
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor reaches, named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without that setting, as in tests, gets a folder of its own;
    on a cluster a machine-local folder would not survive a lost executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder()
