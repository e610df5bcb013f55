"""What runs on a cluster need from a session: the shared folder, and this
package on the executors."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that
    executors need no installed copy."""
    sc = spark.sparkContext
    if getattr(sc, "_wavelens_shipped", False):
        return
    root = Path(__file__).resolve().parent
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    out = Path(tempfile.mkdtemp(prefix="wavelens-")) / "wavelens_pkg.zip"
    out.write_bytes(blob.getvalue())
    sc.addPyFile(str(out))
    sc._wavelens_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a session whose executors
    are threads of this machine (tests) may do without: it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_wavelens_local", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="wavelens-shared-")
            spark._wavelens_local = base
    return base.rstrip("/")
