"""Session helper and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    b = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(shuffle_partitions or 2 * (os.cpu_count() or 4)))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return ship(b.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once per application, so that Python workers can import it.

    Whole texts travel to Python in batches; where the session has the default of 10,000 rows, 2,048 keep them small.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "2048")
    if sc.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        fd, path = tempfile.mkstemp(prefix="pairloom-", suffix=".zip")
        with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
            for folder, _, names in os.walk(here):
                for n in names:
                    if n.endswith(".py"):
                        p = os.path.join(folder, n)
                        z.write(p, os.path.join("pairloom", os.path.relpath(p, here)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark
