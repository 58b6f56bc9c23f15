"""Session settings used by the tests, the bench and local runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Compressed bytes of a shuffle, and bytes of a file, that one task should get. Keys and amounts compress to some twenty
# bytes a row, and a row takes some hundred in the table of an aggregate, so these are about 100 MB for each aggregate.
TASK_SHUFFLE_MB, TASK_FILE_MB = 8, 16


def build_session(app: str = "acctlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join handling and UTC time.

    On a cluster leave ``master`` unset and size ``spark.sql.shuffle.partitions``
    so that one shuffle partition holds about 128 MB; adaptive execution then
    merges small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def fit_tasks(spark: SparkSession, input_bytes: int) -> None:
    """Let the number of tasks follow the input, so that the memory of one does not.

    Adaptive execution starts with a partition for each ``TASK_SHUFFLE_MB`` of the input, never with fewer than the session
    has, and merges small ones up to that size; by default it merges to one for each core or 64 MB, some millions of rows.
    Settings of the session that are smaller already stay. For applications that run over tables of any size; library functions
    change no setting.
    """
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_SHUFFLE_MB), ("spark.sql.files.maxPartitionBytes", TASK_FILE_MB)):
        if size(spark.conf.get(key)) > most << 20:
            spark.conf.set(key, f"{most}m")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // (TASK_SHUFFLE_MB << 20)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(tasks))
