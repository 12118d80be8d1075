"""Session helper shared by the bench, the entry point and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """A local session with the settings that every query here assumes: UTC, AQE and Arrow."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("socspan")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
