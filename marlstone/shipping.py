"""Sending the package to the executors, so that Python workers find it wherever the driver was started."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .lineage import made, shared_dir

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Put the package's sources (a few hundred kilobytes) into the shared folder and add them to the session, once."""
    key = spark.sparkContext.applicationId
    if key in _SENT:
        return
    root = Path(__file__).resolve().parent
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = f"{shared_dir(spark)}/marlstone_sources_{key}.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(raw.getvalue())
    out.close()
    made(spark, path)
    spark.sparkContext.addPyFile(path)
    _SENT.add(key)
