"""Session construction and the shared scratch folder.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names;
we only set our own when it is unset (tests, local runs).
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def get_session(master: str | None = None, app: str = "tessera", **conf: str) -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Read ``spark.checkpoint.dir``; only when unset pick a local folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster-shared checkpoint location."""
    base = ensure_checkpoint_dir(spark)
    path = base.rstrip("/") + f"/tessera/{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path or path.startswith("file:"):
        os.makedirs(path.replace("file:", ""), exist_ok=True)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it back."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession, *modules: str) -> None:
    """Give the workers this package, and further modules beside it, once per
    application: they import its functions, wherever the driver was started."""
    sc = spark.sparkContext
    name = f"tessera-{sc.applicationId}.zip"
    if name in sc._python_includes:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    stage = tempfile.mkdtemp(prefix="tessera-ship-")  # the driver's; Spark sends the archive to the executors
    shutil.copytree(os.path.join(root, "tessera"), os.path.join(stage, "src", "tessera"), ignore=shutil.ignore_patterns("__pycache__"))
    for m in modules:
        shutil.copy(os.path.join(root, f"{m}.py"), os.path.join(stage, "src"))
    sc.addPyFile(shutil.make_archive(os.path.join(stage, name[:-4]), "zip", os.path.join(stage, "src")))
