"""Session construction and shared conventions.

Every operator in the library takes and returns DataFrames keyed by
``series_id`` with the time column ``ts``.  The session settings below are the
ones the operators rely on: UTC session time, ANSI mode (division by zero
raises, so operators use ``try_divide``), adaptive query execution (runtime
broadcast of small per-series tables, skew-join splitting, partition
coalescing).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SERIES = "series_id"
TS = "ts"
PRICE = "price"
IDX = "idx"

# The optional driver columns the reference recognises, in its order.
DRIVERS = ["temperature", "wind_speed", "solar_irradiance", "precipitation", "load"]


def build_session(master: str | None = None, app: str = "tidemark", shuffle_partitions: int | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master and master.startswith("local"):  # the driver is the only worker
        builder = builder.config("spark.driver.memory", "8g")
    if shuffle_partitions:  # else the cluster's own setting holds
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # noqa: BLE001
        pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; a local run gets one of its own when it
    is unset.  On any other master an unset folder is an error, for executors
    would not see a folder of the driver's machine.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Spark Connect session has no context here
        sc = None
    d = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc is not None else None)
    if not d:
        import tempfile

        if sc is None or not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - some sessions refuse core settings at run time
            pass
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for written intermediate tables)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, *parts])
