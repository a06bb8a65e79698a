"""Session factory and the code shipping that Python workers need."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps; ``conf`` overrides any setting."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors unless their PYTHONPATH already has it.

    A cluster submission that uses ``--py-files`` or an installed wheel needs no shipping; sessions
    started elsewhere (a notebook, a test driver) do.
    """
    root = str(PACKAGE.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if getattr(context, "_quern_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="quern")) / "quern.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in PACKAGE.rglob("*.py"):
            archive.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(target))
    context._quern_shipped = True
