"""Makes this package importable in Python workers, and names the folder that all of a cluster's machines see."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

from millrace.errors import MillraceError

_shipped: set[str] = set()
#: Where intermediate tables go in local mode if the session names no folder.
LOCAL_FOLDER = "file:///tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without it there is one in local mode alone: elsewhere machines don't share theirs."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise MillraceError("spark.checkpoint.dir must name a folder that all machines share")
    return LOCAL_FOLDER


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to all executors through Spark, once in each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
