"""Hands the package to Python workers that cannot import it by themselves."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources once per application through Spark's own file server."""
    sc = spark.sparkContext
    if getattr(sc, "_palimpsest_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="palimpsest-src-")) / "palimpsest_src.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(out))
    sc._palimpsest_shipped = True
