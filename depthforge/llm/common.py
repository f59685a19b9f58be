"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and U+0009..U+000D.
SPACES = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``, the folder all executors share.

    Where that setting is absent, a folder set by ``setCheckpointDir`` serves; with neither, a session on one
    machine gets a temporary folder and any other an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="depthforge-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/depthforge/{uuid.uuid4().hex}"


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to hand texts to Python in batches of 250 rows at most: whole documents are long."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= 250:
        conf.set(name, "250")
    return df


def stored(df: DataFrame, free: bool = False, few: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``few``: in a quarter as many files as the session has shuffle partitions (32 at least); only for what a
    join or an aggregation leaves, small against what was shuffled for it, never for scans or Python stages.
    ``free``: first let Spark's cleaner drop the shuffle files of earlier steps whose frames are no longer held.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    for _ in range(2 if free else 0):  # the first round releases the plans, the second what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    if few:
        df = df.coalesce(max(32, partitions(spark) // 4))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` with underscores in front until none of ``columns`` is like one of them."""
    taken = {c.lower() for c in columns}
    while taken & {n.lower() for n in names}:
        names = tuple(f"_{n}" for n in names)
    return list(names)


def words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters of ``text``; null text: empty."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACES}]+|[{SPACES}]+$", "")
    return F.when(F.length(clean) > 0, F.split(clean, f"[{SPACES}]+")).otherwise(F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)
