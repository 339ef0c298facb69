"""Sends the package to Python workers that do not have it on their path, as ``--py-files`` does."""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def _send(context: SparkContext, top: str) -> None:
    if context.applicationId not in _sent:
        _sent.add(context.applicationId)
        place = Path(tempfile.mkdtemp())
        shutil.copytree(Path(top) / "panelcast", place / "own" / "panelcast", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(place / "panelcast"), "zip", place / "own"))


def with_package(query: Callable[[SparkSession, str], DataFrame], top: str) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _send(spark.sparkContext, top)
        return query(spark, sf_dir)

    return run
