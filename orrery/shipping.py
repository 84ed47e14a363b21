"""Makes this package importable in Python workers, whatever folder the session was started in."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the workers, once per application; the zip is read on the driver only."""
    app = spark.sparkContext.applicationId
    if app not in _DONE:
        root = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{root.name}.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(archive)
        _DONE.add(app)
    return spark
