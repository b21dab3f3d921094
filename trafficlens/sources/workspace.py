"""Where jobs put intermediate files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder;
    on a cluster executors could not see it, so there the setting is required.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="trafficlens-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_tree(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
