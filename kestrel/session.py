"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings the operators assume.  Timestamps are compared as UTC wall-clock
# values, AQE re-plans shuffles at runtime (coalescing small partitions and
# splitting skewed join partitions), and Arrow carries the few pandas paths.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


MB = 1 << 20


def cluster_conf(input_bytes: int, total_cores: int, target_partition_mb: int = 128,
                 scan_split_mb: int = 256, max_partitions: int = 100_000) -> dict[str, str]:
    """Partition sizing for a cluster run over ``input_bytes`` of Parquet.

    Scan splits of ``scan_split_mb`` (a task reads about that much
    compressed input).  The initial shuffle partition count keeps a reducer
    near ``target_partition_mb`` if the whole input were shuffled, with at
    least two waves of the cluster's cores, and at most ``max_partitions``
    (map-output metadata grows with mappers x reducers).  The shuffles here
    carry projections and partial aggregates, a fraction of the input, and
    AQE coalesces partitions toward the advisory size at run time and
    splits skewed join partitions above 4x the median (and 256 MB).  E.g.
    10^14 bytes on 1000 executors x 8 cores: 100,000 initial partitions,
    about 400,000 scan tasks.
    """
    partitions = min(max_partitions, max(2 * total_cores, -(-input_bytes // (target_partition_mb * MB))))
    return {
        "spark.sql.files.maxPartitionBytes": str(scan_split_mb * MB),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_mb * MB),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * MB),
    }


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "kestrel", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()        # applications that have the package
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application.

    Functions that run in Python workers refer to the package by name; a
    cluster where it isn't installed gets it as a zip by Spark's file server.
    Any thread may be the first to do so, a stream's micro-batches too; the
    file server refuses a name that it holds already, so each zip has its own.
    """
    sc = spark.sparkContext
    with _SHIPPING:
        if sc.applicationId in _SHIPPED:
            return
        root = os.path.dirname(os.path.abspath(__file__))
        if os.path.isdir(root):        # else the package itself was loaded from a zip
            path = os.path.join(tempfile.mkdtemp(prefix="kestrel-src-"), f"kestrel-{uuid.uuid4().hex[:12]}.zip")
            with zipfile.ZipFile(path, "w") as z:
                for folder, _, files in os.walk(root):
                    for f in sorted(files):
                        if f.endswith(".py"):
                            full = os.path.join(folder, f)
                            z.write(full, os.path.relpath(full, os.path.dirname(root)))
            sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is; a cluster without it (``local-cluster`` counts as one) is an
    error: a machine-local folder would not survive a lost executor, nor be
    seen by the others.  Only a
    local master (tests, benches) gets a folder of our own when it is unset.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="kestrel-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df, name: str = "table"):
    """Write ``df`` under the shared checkpoint folder and read it back.

    One job; the lineage is cut there, the result survives lost executors,
    and every later consumer reads the same rows (no recomputation).
    """
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
