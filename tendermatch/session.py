"""Session construction and lineage helpers."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours wants. Cluster deployments override the
# sizing ones (shuffle partitions, max partition bytes) through spark-submit.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # A side is broadcast when its size is known to be small (literal key lists,
    # small files), when a structural bound holds (hints in the operators), or
    # by AQE from the *measured* size of a finished shuffle stage.
    "spark.sql.autoBroadcastJoinThreshold": str(4 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tendermatch", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    It is read from the session. Where it is unset a single-machine session
    (``local[...]``) gets a folder under its warehouse; on a cluster an unset
    folder is an error, because executors could not read each other's files.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if not named and current:
        return current
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", named)
    if not current:
        sc.setCheckpointDir(named)
    return named


MATERIALIZE_CONF = "spark.tendermatch.materialize"


def materialize(df: DataFrame, mode: str | None = None) -> DataFrame:
    """Pin an intermediate result that is read more than once.

    ``persist`` (default) keeps blocks in memory/disk; lost blocks are
    recomputed from a deterministic lineage (all our pinned plans order by
    unique keys). ``checkpoint`` writes to the shared checkpoint folder
    (``spark.checkpoint.dir``) and cuts lineage -- choose it for very long
    pipelines or unreliable executors with ``spark.tendermatch.materialize``.
    """
    mode = mode or df.sparkSession.conf.get(MATERIALIZE_CONF, "persist")
    if mode == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    pinned = df.persist(StorageLevel.MEMORY_AND_DISK)
    _PINNED.append(pinned)
    return pinned


_PINNED: list[DataFrame] = []


def release_pinned() -> None:
    """Give up every frame that :func:`materialize` persisted so far. Results that
    are read later still come out right: their blocks are computed again."""
    while _PINNED:
        _PINNED.pop().unpersist()
