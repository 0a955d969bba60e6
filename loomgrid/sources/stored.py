"""Tables written in the folder that driver and executors share, to cut lineage in a way that lost executors don't undo."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task numbers in order, a few MB.
ONE_TASK = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = "file://" + tempfile.mkdtemp(prefix="loomgrid-")
    spark.conf.set("spark.checkpoint.dir", found)
    spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later plans start from the files, and several of them read one result without computing it again.
    The files stay until the folder's owner clears it, like checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgrid/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, keys: list[str], deal: bool = True) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed and sorted by ``keys``: joins and groups by these read it without a shuffle.
    ``deal=False``: nor does writing it shuffle, but a bucket has as many files as tasks hold rows of it."""
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(many, *keys).sortWithinPartitions(*keys) if deal else df
    dealt.write.bucketBy(many, *keys).sortBy(*keys).option("path", f"{shared_dir(spark)}/loomgrid/{name}").saveAsTable(name)
    return spark.table(name)


def ranked(rows: DataFrame, order: list, label: str, many: int | None = None) -> DataFrame:
    """``rows`` with ``place``: their number from 0 in the order, over all of them. Rows are sorted by ranges, so no task holds them all,
    and only the size of each range comes to the driver; up to ``ONE_TASK`` rows, where ``many`` says that there are no more, one task
    numbers them. Rows equal in the whole order are numbered in any way."""
    if many is not None and many <= ONE_TASK:
        return rows.withColumn("place", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = stored(placed, label)
    sizes = placed.groupBy(F.shiftright("place", 33).alias("range")).count().orderBy("range").collect()
    starts, before = [], 0
    for r in sizes:
        starts.append((r["range"], before))
        before += r["count"]
    starts = placed.sparkSession.createDataFrame(starts, "__range long, __before long")
    met = placed.join(F.broadcast(starts), F.shiftright("place", 33) == F.col("__range"))
    return met.withColumn("place", F.col("__before") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("__range", "__before")
