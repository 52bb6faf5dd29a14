"""Sensitive-data analytics and corpus preparation on Spark DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where its folder is visible to them; clusters use --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
