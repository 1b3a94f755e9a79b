"""The session that queries expect, and the package on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "_threadloom_shipped"


def session(master: str = "local[*]", partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf overrides."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(partitions or os.cpu_count()), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    return SparkSession.builder.master(master).config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application: they need not have it installed."""
    sc = spark.sparkContext
    root = Path(__file__).parent
    if getattr(sc, _SHIPPED, False) or not root.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="threadloom-")) / "threadloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("threadloom") / p.relative_to(root))
    sc.addPyFile(str(target))
    setattr(sc, _SHIPPED, True)
