"""Session defaults and the shared folder for staged tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "opslog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Partition counts are left to the cluster and to adaptive execution unless
    the caller names them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # State of many blocks does not fit executor memory.
        STATE_STORE: ROCKSDB,
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, whatever the session was built with.

    State of several variables needs it. A stream takes the settings of its session when it starts, so the
    caller's setting is put back at once.
    """
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else the warehouse.

    Spark needs its warehouse on storage that all executors share, so neither is
    a temporary folder of one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return configured.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/opslog/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``options`` are those of the writer.

    This cuts the lineage: later steps re-read files after losing an executor
    and see the very same rows, whatever non-deterministic steps made them.
    """
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by keys before costly Python work on each group or bundle.

    A named number of partitions keeps adaptive execution from merging them:
    it goes by bytes, while this work goes by groups.
    """
    return df.repartition(shuffle_partitions(df.sparkSession), *keys)
