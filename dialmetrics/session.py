"""Session helpers: recommended settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the reports rely on for scale; all are plain Spark configuration.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key's partition even where that costs an extra shuffle: one key
    # holding a large share of the rows would otherwise be one straggler task
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Starting points for a large cluster (~100 TB of attempts): many shuffle
# partitions that AQE coalesces to the advisory size, larger scan splits, and
# skew handling for the customer join. Tune to the cluster; all plain Spark.
CLUSTER_CONF = {
    **RECOMMENDED_CONF,
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "dialmetrics",
                  extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in {**RECOMMENDED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def with_profile(spark: SparkSession) -> SparkSession:
    """Give an open session the recommended settings it does not set itself, and on a
    cluster the cluster's (partition sizes, shuffle partitions)."""
    local = spark.sparkContext.master.startswith("local")
    own = dict(spark.sparkContext.getConf().getAll())
    for k, v in (RECOMMENDED_CONF if local else CLUSTER_CONF).items():
        if k not in own:
            spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of this session.

    On a cluster it is the shared folder named by ``spark.checkpoint.dir`` (or one
    set with ``setCheckpointDir``). Only a local-mode session without one (tests)
    gets a fresh scratch folder; a cluster session without one is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="dialmetrics-ckpt-"))
    return sc.getCheckpointDir()
