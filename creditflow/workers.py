"""Letting Python workers import this package where it is not installed."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> SparkSession:
    """Put the package's folder on the workers' path, for runs from another folder.

    On a cluster the package is installed or passed with ``--py-files``; a path that is not there does no harm.
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark
