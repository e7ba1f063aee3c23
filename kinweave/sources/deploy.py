"""Send this package to the executors, for functions that run in Python there.

Texts may be long, so Arrow batches are held to ``ARROW_ROWS`` rows where the
session has Spark's default: a batch is in memory several times, in the JVM and
in the worker.
"""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()
ARROW_KEY, ARROW_DEFAULT, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1024"


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once an application."""
    context = spark.sparkContext
    if spark.conf.get(ARROW_KEY) == ARROW_DEFAULT:
        spark.conf.set(ARROW_KEY, ARROW_ROWS)
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parents[1]
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent).as_posix())
    out = Path(tempfile.mkdtemp(prefix="kinweave-")) / "kinweave.zip"
    out.write_bytes(blob.getvalue())
    context.addPyFile(str(out))
    _SENT.add(context.applicationId)
