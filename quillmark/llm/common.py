"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows a batch that goes to Python, at most: whole texts are large rows.
BATCH_ROWS = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors; lowers the session's rows a batch to BATCH_ROWS."""
    shipping.ship(spark)
    now = int(spark.conf.get(BATCH_SETTING, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the cluster's checkpoint folder and read back.

    The folder is ``spark.checkpoint.dir``. Only a local session without the
    setting gets a temporary folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp()
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` (from :func:`cut`) with consecutive row numbers from 0 in its row order.

    One count per partition goes to the driver and back, no row.
    """
    spark = df.sparkSession
    counts = sorted((r[0], r[1]) for r in df.groupBy(F.spark_partition_id()).count().collect())
    offsets, total = [], 0
    for part, count in counts:
        offsets.append((part, total))
        total += count
    place = spark.createDataFrame(offsets, "_part int, _offset long")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.withColumns({"_part": F.spark_partition_id(), "_within": within})
    return (
        rows.join(F.broadcast(place), "_part")
        .withColumn(name, F.col("_offset") + F.col("_within"))
        .drop("_part", "_within", "_offset")
    )


def upto(count: Column | int) -> Column:
    """One row for each of 0..count-1 (count is 1 at least)."""
    last = (count if isinstance(count, Column) else F.lit(count)).cast("long") - 1
    return F.explode(F.sequence(F.lit(0).cast("long"), last))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores before it as keep it apart from the columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
