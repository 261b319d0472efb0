"""Session helpers: recommended settings and reliable lineage cuts."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession

# AQE coalesces small shuffle partitions and splits skewed joins, so a high initial count is safe on a cluster.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the recommended settings to a session builder."""
    for key, value in CLUSTER_SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or one below the warehouse, which executors share as well.

    A path without a scheme is Spark's default file system's, and comes back with that scheme for readers outside Spark.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        if shared.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            warnings.warn(f"spark.checkpoint.dir is not set; {shared} must be a folder that all executors share", stacklevel=2)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    place = spark._jvm.org.apache.hadoop.fs.Path(shared)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder so several outputs share one computation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
