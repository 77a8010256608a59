"""Python workers must find this package: functions of its modules are sent by name."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path. Executors on other machines get the package by --py-files or an
    archive; there the folder doesn't exist and the entry does no harm."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])
