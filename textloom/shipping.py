"""Give the executors this package, wherever the driver imported it from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()

#: Rows and bytes that cross to Python at a time; rows here are whole texts, and the defaults suit numbers.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of this application, once, and let batches be a few MB of text; a session's own smaller sizes stay."""
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) <= 0 or int(now) > int(most):
            spark.conf.set(key, most)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="textloom-")) / "textloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*")):
            if path.is_file() and path.suffix != ".pyc":
                z.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
