"""A session for local work, and how Python workers come to find this package."""

from __future__ import annotations

import os
import secrets
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of a batch that goes to a Python worker: the default counts rows alone, and 10,000 long texts are too many.
BATCH_BYTES = 4 << 20


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName("stallmark")
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = b.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Puts this package on the path of Python workers, beyond one machine by sending it, bounds their batches, and gives
    them the key under which this application hashes words."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    sc.environment.setdefault("STALLMARK_HASH_KEY", os.environ.setdefault("STALLMARK_HASH_KEY", secrets.token_hex(16)))
    root = str(Path(__file__).resolve().parent.parent)
    known = sc.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        sc.environment["PYTHONPATH"] = f"{root}:{known}" if known else root
    if not sc.master.startswith("local") and sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/stallmark", "zip", root, "stallmark"))
    return spark
