"""Lets Python workers import this package where the driver was not started in its folder."""

from __future__ import annotations

import os
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def query(f):
    """A registered query (spark, sf_dir) whose workers find this package."""

    @wraps(f)
    def run(spark: SparkSession, sf: str):
        importable(spark)
        return f(spark, sf)

    return run
