"""Tables in the folder that driver and executors share, for jobs that read their own results again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder; a temporary folder only in local mode, where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="panelcast-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


class Staged:
    """Tables written and read again, which cuts their lineage and survives the loss of an executor; ``drop`` removes those
    that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._paths: dict[int, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self._spark, name)
        df.write.parquet(path)
        out = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for path in filter(None, (self._paths.pop(id(t), None) for t in tables)):
            place = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
