"""Python workers get this package from Spark, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import lodestar

_SHIPPED: set[str] = set()
#: Bytes of a batch between Spark and Python, where the session has Spark's own default: long texts fill workers otherwise.
BATCH, DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
BATCH_BYTES = 12 << 20


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once an application, and keep Arrow batches small."""
    if spark.conf.get(BATCH, None) in (f"{DEFAULT_BATCH}b", str(DEFAULT_BATCH)):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = os.path.dirname(os.path.abspath(lodestar.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="lodestar-"), "lodestar.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lodestar", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(target)
