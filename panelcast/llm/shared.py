"""What the corpus operators share: tables in the cluster's shared folder, joins by checked size, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of keys (a row of at most about 100 bytes each) of at most so many rows is sent to every executor; a longer one
#: is joined by shuffle.
BROADCAST_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelcast-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelcast-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: it cuts lineage, survives the loss of
    any executor, and gives the planner real sizes."""
    return _write(df, name)[0]


class Scratch:
    """Staged tables of one job, which can be removed when nothing is read from them any more."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._tables: list[tuple[DataFrame, str]] = []

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        self._tables.append(_write(df, name))
        return self._tables[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        """Remove these tables; what was made from them must be staged itself."""
        for df, path in [t for t in self._tables if any(t[0] is x for x in tables)]:
            self._remove(path)
            self._tables = [t for t in self._tables if t[0] is not df]

    def drop_all(self, *but: DataFrame) -> None:
        self.drop(*(t[0] for t in self._tables if not any(t[0] is x for x in but)))

    def _remove(self, path: str) -> None:
        jvm, context = self._spark.sparkContext._jvm, self._spark.sparkContext._jsc
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context.hadoopConfiguration()).delete(place, True)


def small_or_not(keys: DataFrame) -> DataFrame:
    """A staged table of keys, marked for broadcast only if its counted rows are at most BROADCAST_ROWS."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def text_bytes(docs: DataFrame) -> Column:
    """UTF-8 bytes of the text, null as empty."""
    return F.coalesce(docs["text"], F.lit("")).cast("binary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
