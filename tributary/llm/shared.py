"""Small helpers that every operator of this package uses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to Python; whole texts travel, so fewer rows than Spark's default bound memory.
BATCH_ROWS = 500


def tune(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, unless the session asks for fewer already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (as in tests)."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder, so that lost executors lose no work."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table; it is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/tributary-{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: So many keys of the most rows are hot; any other holds less than one row in so many.
HOT_SHARE = 1000
#: Keys of fewer rows are never hot.
HOT_LEAST = 512


def hot_keys(counts: DataFrame, *key: str) -> DataFrame | None:
    """The hot keys of counts (key, n), one row each and at most HOT_SHARE; None if there are none."""
    found = counts.select(*key, "n").where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), *key).limit(HOT_SHARE).collect()
    return counts.sparkSession.createDataFrame([tuple(x)[:-1] for x in found], counts.select(*key).schema) if found else None


def meet(rows: DataFrame, table: DataFrame, key: str | list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Rows joined to a table of one row for each key; the hot keys' rows stay where they are, and their part of the table,
    at most HOT_SHARE rows, is broadcast."""
    if hot is None:
        return rows.join(table, key, how)
    few = F.broadcast(hot)
    rest = rows.join(few, key, "left_anti").join(table, key, how)
    return rest.unionByName(rows.join(F.broadcast(table.join(few, key, "left_semi")), key))


def crc_mod(column: str, modulus: int):
    """crc32 of an id written as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
