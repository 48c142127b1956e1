"""Session set-up and the one place that knows where checkpoints go."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on. All of them can be changed on a
# running session, so they also apply to a session the caller made.
RUNTIME_CONF = {
    # Wall-clock columns are TIMESTAMP_NTZ; epoch arithmetic needs UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys are split at run time, even when that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # In 4.1 a union that claims the partitioning of its inputs can disagree with adaptive
    # coalescing of one of them, which fails a later join.
    "spark.sql.unionOutputPartitioning": "false",
    # Rows go to Python by bytes, not by number, so that long texts do not fill a worker.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

#: Drops the shuffles behind a result when its job has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Applies :data:`RUNTIME_CONF` to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    # Python workers import this package; where it isn't installed, they find it where we did.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    return spark


def build_session(
    app: str = "daytrail",
    *,
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


@functools.cache
def _own_folder() -> str:
    """A folder for a local session, removed when Python ends."""
    own = tempfile.mkdtemp(prefix="daytrail-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own, so that the same plan runs
    everywhere. On a cluster the setting is needed: a machine-local folder would be lost with
    the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] == "local":
        return _own_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def new_folder(spark: SparkSession) -> str:
    """The path of a new folder for written tables under :func:`checkpoint_dir`."""
    return f"{checkpoint_dir(spark)}/daytrail-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` once and reads it back, so that several branches share the result.

    The copy is a Parquet table in the checkpoint folder: it survives lost executors, keeps
    column pruning, and tells Spark its real size when joins are planned. Whoever reads it needs
    none of the shuffles behind it, so these go with the job that wrote it.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`cut_lineage` gave and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {unquote(file).rsplit("/", 1)[0] for file in table.inputFiles()}:
            if not folder.rsplit("/", 1)[1].startswith("daytrail-"):
                raise ValueError(f"not a table of cut_lineage: {folder}")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
