"""Session helpers: a local session for tests and benches, the package on the executors, and a shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: dict[str, bool] = {}


def local_session(cores: int | str = "*", app: str = "driftwell", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings every query here relies on (UTC, AQE, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that jobs also run where it is not installed."""
    sc = spark.sparkContext
    if _SHIPPED.get(sc.applicationId):
        return
    _SHIPPED[sc.applicationId] = True
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:  # on the driver only: addPyFile copies it to where executors fetch it
        archive = Path(folder) / "driftwell_package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        kept = Path(tempfile.mkdtemp(prefix="driftwell-ship-")) / archive.name
        kept.write_bytes(archive.read_bytes())
    sc.addPyFile(str(kept))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables in the folder of spark.checkpoint.dir, which all machines share; one on this machine only where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else tempfile.mkdtemp(prefix="driftwell-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
