"""Sends this package to the executors, so that Python workers can import it wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
BATCH, DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python files, once for each application."""
    if spark.conf.get(BATCH, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(BATCH, "1000")  # documents are long: the default of 10,000 rows takes hundreds of MB in a worker
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = Path(__file__).parent
    name = Path(tempfile.mkdtemp(prefix="factloom-")) / "factloom-package.zip"
    with zipfile.ZipFile(name, "w") as out:
        for path in sorted(home.rglob("*.py")):
            out.write(path, path.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(name))
    _SHIPPED.add(app)
