"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split at run time even where that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rank limits of this size still cut each task's rows before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
    # JSON objects that repeat a key keep the last value instead of failing.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Streaming state lives on disk, not in the executors' heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators rely on; cluster sizing is left alone.

    On a cluster the package goes to the executors once per application.
    """
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if not context.master.startswith("local") and context.applicationId not in _shipped:
        context.addPyFile(packed_package())
        _shipped.add(context.applicationId)
    return spark


def packed_package() -> str:
    """A zip of this package's modules, for ``addPyFile``; Spark's file server hands it out."""
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="tabsift-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for module in sorted(root.rglob("*.py")):
            out.write(module, module.relative_to(root.parent))
    return str(target)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is used only on a
    local master, where driver and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="tabsift-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call returns."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, which outlives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, the figure it sizes broadcasts with."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def split_bytes(spark: SparkSession) -> int:
    """The most bytes of a file that one task reads."""
    named = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(named))
