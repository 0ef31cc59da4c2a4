"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings for local runs, and advice for a cluster: UTC arithmetic, run-time re-planning and
# the splitting of skewed join partitions even where that costs one more exchange.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Deep pages (order, offset, limit) are sorted by the executors, not gathered on the driver.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
    # Pages are large values, so batches handed to Python hold fewer of them.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


_OWN_DIRS: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session of one's own; the library never changes a caller's session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``.

    Where the setting is absent, one temporary folder is made per application if all tasks run
    in the driver's process; elsewhere that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = tempfile.mkdtemp(prefix="canvasser-")
        found = _OWN_DIRS[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "canvasser") -> SparkSession:
    """Session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
