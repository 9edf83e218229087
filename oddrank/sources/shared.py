"""The folder that the driver and all executors share, and tables kept in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Columns that tables are partitioned by: texts, whatever they look like.
KEYS = frozenset({"run_id", "group_key", "config_hash", "period_label"})


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where that is unset in local mode (tests) a temporary folder is made
    and removed at exit; on a cluster such a folder would be another one on each
    machine, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="oddrank-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in folders by some columns if wanted, and read it again.

    Whatever is built on the result reads the same rows in the same parts, however
    often and from however many branches, and can be recomputed from files when
    an executor is lost.
    """
    path = new_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """A partitioned table whose keys are read as the texts they are, not as the numbers or dates they look like."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType() if f.name in KEYS else f.dataType, True) for f in found.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)
