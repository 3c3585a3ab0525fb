"""Session and table access."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidemill", memory: str = "8g") -> SparkSession:
    """A local session for tests and benches: UTC, AQE, Arrow."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if it isn't installed for them."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), root) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of ``sf_dir``."""
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
