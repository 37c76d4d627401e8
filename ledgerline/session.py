"""Session settings the operators are designed for."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Skewed joins are left to adaptive execution: it splits the oversized side of
# a sort-merge join at run time. The force flag lets it do so even when a later
# stage then needs one more exchange.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows can be long texts or pages, so few of them go into one Arrow batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Idle state expires along with the next rows; otherwise a query that is to end when its input is used up would
    # run empty batches for ever to look for expired state.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

_shipped: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session and give its executors the package."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors once per application, so that it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped or context.master.startswith("local["):
        return
    package = Path(__file__).resolve().parent
    if not package.is_dir():  # imported from an archive that was shipped already
        return
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def build_session(app: str = "ledgerline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
