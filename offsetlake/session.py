"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()

#: Bytes of the Arrow batches sent to Python workers, where the session names no other size: rows with long texts would make large batches.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, with UTC as time zone."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each context, so that functions in it can be unpickled there; and bound Arrow batches."""
    context = spark.sparkContext
    if not spark.conf.get(BATCH[0], None):
        spark.conf.set(*BATCH)
    if context in _shipped:
        return spark
    top = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="offsetlake-ship-"), "offsetlake.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, path.relative_to(top.parent))
    context.addPyFile(target)
    _shipped.add(context)
    return spark
