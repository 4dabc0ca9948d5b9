"""Python workers and this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if no --py-files ships it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(":"):
        env["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
