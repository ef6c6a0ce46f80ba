"""Tables that cut lineage: Parquet in the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of this process, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="stallmark-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Within, a finished query gives its shuffle files back at once: what it wrote is what later steps read."""
    was = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, was)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again: survives lost executors and starts a new lineage."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that materialize wrote and nothing will read again."""
    for df in tables:
        if df is not None:
            drop_path(df.sparkSession, df.scratch)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], copies: str, most: int = 1000) -> DataFrame:
    """rows joined by keys with a table of one row a key, whose column `copies` counts the rows of the key. Keys that
    hold a share of 1 / most of all rows are fewer than most, so their rows of the table are broadcast and those of
    `rows` stay where they are; the others are shuffled. Both should be materialized: they are read twice."""
    total = table.agg(F.sum(copies)).first()[0] or 0
    hot = table.where(F.col(copies) * most > total)
    large = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(copies) * most <= total), keys)
    return large.unionByName(rest)
