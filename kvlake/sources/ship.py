"""Getting this package to Python workers that could not import it otherwise."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from kvlake.sources.store import is_local

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the context, once, unless workers are children of this process that find it as this one does."""
    context = spark.sparkContext
    known = [Path(p or ".").resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), "."]]
    if (is_local(spark) and ROOT in known) or getattr(context, "_kvlake_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="kvlake-zip-")) / "kvlake.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted((ROOT / "kvlake").rglob("*.py")):
            out.write(source, source.relative_to(ROOT))
    context.addPyFile(str(path))
    context._kvlake_shipped = True
