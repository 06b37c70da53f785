"""Tables in the folder that all executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all runs in one process, as in tests, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='rulewright-')}"
        atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a table in the shared folder, read back; in folders by the columns ``by``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table = table.select(*df.columns) if by else table
    _PATHS[table] = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again, so that only those in use take disk."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
