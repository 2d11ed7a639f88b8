"""What a session needs before it runs this package's functions on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch, so that a batch of long texts stays small on both sides.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the session's Python workers, once, and bound its Arrow batches."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    name = os.path.join(tempfile.mkdtemp(), "orrery.zip")  # on the driver; Spark's file server hands it out
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(name)
    _shipped.add(context.applicationId)
