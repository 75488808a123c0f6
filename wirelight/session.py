"""Session settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Session settings: UTC timestamps, and no generated method the JIT refuses.

    HotSpot never compiles methods over 8000 bytes of bytecode.  With the limit
    set, Spark falls back to split-up projections for the few operators that wide
    text parsing would push over it.
    """
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Gives executors this package, once per application.

    Without it Python functions only run where the executors happen to find the
    package, such as in the driver's own folder.
    """
    context, name = spark.sparkContext, __package__.partition(".")[0]
    if getattr(context, "_shipped", None) != name:
        root = os.path.dirname(os.path.abspath(__file__))
        archive = f"{tempfile.mkdtemp(prefix=name)}/{name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, files in os.walk(root):
                for file in files:
                    if file.endswith(".py"):
                        path = os.path.join(folder, file)
                        out.write(path, os.path.join(name, os.path.relpath(path, root)))
        context.addPyFile(archive)
        context._shipped = name
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory for checkpoints and intermediate tables.

    The parent is the shared folder the cluster names in ``spark.checkpoint.dir``.
    Only where that is unset (tests, local mode) a local folder is used.
    """
    parent = spark.conf.get(CHECKPOINT_CONF, None)
    if not parent:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        parent = tempfile.mkdtemp(prefix="wirelight-")
    return f"{parent.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
