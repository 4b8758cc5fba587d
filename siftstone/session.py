"""Sessions and what they need: settings for local runs, and the package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on this machine, as for tests and the bench."""
    conf = {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local session, as in tests, gets a temporary one where it is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="siftstone-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage cut; a lost executor costs nothing that was finished."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors of a session, once; Python functions are found there by module."""
    sc = spark.sparkContext
    if getattr(sc, "_siftstone_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="siftstone-")) / "siftstone.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f"{PACKAGE.name}/{f.relative_to(PACKAGE)}")
    sc.addPyFile(str(archive))
    sc._siftstone_shipped = True
