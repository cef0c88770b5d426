"""Session construction and the shared folder for lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job here relies on: adaptive execution (runtime broadcast conversion,
# partition coalescing, skew-join splitting) and Arrow for the one pandas batch path.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str | None = "local[8]", shuffle_partitions: int = 8,
                  driver_memory: str = "16g", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above. On a cluster pass master=None
    and size ``shuffle_partitions`` so a shuffle partition stays around 128-256 MB."""
    b = SparkSession.builder.appName("ludex")
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; only a local-mode session (tests, a laptop) gets a fresh
    scratch folder when none is set. A cluster without the setting is an error: a
    machine-local folder would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if d:
            sc.setCheckpointDir(d)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
        d = tempfile.mkdtemp(prefix="ludex-ckpt-")
        sc.setCheckpointDir(d)
    return d


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application (``addPyFile`` of a zip),
    so Python functions run there whatever folder or machine a worker starts in."""
    sc = spark.sparkContext
    if getattr(sc, "_ludex_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="ludex-zip-"), "ludex.zip")   # driver side only
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._ludex_shipped = True


def materialize(df, name: str, **write_options):
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives the loss
    of executors, and gives the next step a plain scan with known sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**write_options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within it, the shuffle files of a query (a write, a collect) go as the query ends. Else
    they stay until the driver happens to collect its garbage, so the shuffles of all steps
    lie on disk at once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder for a written intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
