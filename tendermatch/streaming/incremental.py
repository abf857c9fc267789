"""Incremental processing with Structured Streaming.

The reference's only streaming-shaped behaviour is "fit once, then transform
chunk after chunk and append". Here new input files arrive through a file
stream source; every micro-batch is transformed with the *fixed* fitted state
(the categorical lookups are stream-static joins) and written by
``foreachBatch`` into a folder named after the batch id. A batch that is
replayed overwrites its own folders and is compared with those of other
batches only, so a replay gives what one clean run gives.

Primary keys are enforced across chunks before a batch is written: a key log
beside the sink (``sources.keyfilter``) keeps the keys of each batch, by a hash
of the key, and a Bloom filter of them. A batch whose keys the filters rule out
reads no stored key; otherwise it reads the partitions of its possible hits.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendermatch.operators.contracts import assert_pk
from tendermatch.operators.text import TEXT_DEFAULTS, refresh_vectors, text_transform
from tendermatch.sources import keyed
from tendermatch.sources.keyfilter import KeyLog
from tendermatch.sources.readers import _exists, _path

KEY_PARTITIONS = 64


def _check_keys(spark: SparkSession, out: DataFrame, pk: Sequence[str], keys: str, epoch: int, partitions: int) -> None:
    """Fail on keys that repeat in the batch or that another batch wrote; else note them under the batch's name."""
    assert_pk(out, pk)
    log = KeyLog(spark, keys, pk, partitions)
    clash = log.clashes(out, epoch)
    if clash is not None and not clash.isEmpty():
        raise ValueError(f"batch {epoch} repeats keys already written")
    log.add(out, epoch)


def transform_stream(spark: SparkSession, source: str, schema, prepare: Callable[[DataFrame], DataFrame],
                     transform: Callable[[DataFrame], DataFrame], pk: Sequence[str], sink: str, checkpoint: str,
                     max_files_per_trigger: int = 1, check_keys: bool = True, glob: str | None = None,
                     key_partitions: int = KEY_PARTITIONS) -> DataFrame:
    """Run the stream over the files of folder ``source`` (optionally matching ``glob``) to
    completion (availableNow) and return the sink contents."""
    stream = prepare(_file_stream(spark, source, schema, glob).option("maxFilesPerTrigger",
                                                                      max_files_per_trigger).load())

    def per_batch(batch: DataFrame, epoch: int) -> None:
        out = transform(batch)
        if check_keys:
            _check_keys(spark, out, pk, f"{sink.rstrip('/')}_keys", epoch, key_partitions)
        out.write.mode("overwrite").parquet(os.path.join(sink, f"batch={epoch}"))

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)


def refresh_vectors_stream(spark: SparkSession, source: str, schema, target_base: str, pk: Sequence[str],
                           text_col: str, vec_col: str, checkpoint: str, dim: int = 8,
                           prepare: Callable[[DataFrame], DataFrame] | None = None, glob: str | None = None) -> str:
    """Each micro-batch of (pk, text) updates ``vec_col`` of the current target version by key.

    Versions live in ``target_base/v=<number>``; batch ``e`` writes number
    ``e + 1`` from the newest complete version below it, so that a replayed
    batch starts from what it started from before and never reads what it
    overwrites. A version without its success mark is not complete. Returns the
    path of the final version.
    """
    def per_batch(batch: DataFrame, epoch: int) -> None:
        current = spark.read.parquet(_version_before(spark, target_base, epoch + 1))
        new = refresh_vectors(current, batch, pk, text_col, vec_col, dim=dim)
        new.write.mode("overwrite").parquet(os.path.join(target_base, f"v={epoch + 1:09d}"))

    stream = _file_stream(spark, source, schema, glob).load()
    if prepare is not None:
        stream = prepare(stream)
    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return _version_before(spark, target_base)


def refresh_vectors_log(spark: SparkSession, source: str, schema, base: str, pk: Sequence[str], text_col: str, vec_col: str,
                        checkpoint: str, dim: int = 8, prepare: Callable[[DataFrame], DataFrame] | None = None,
                        glob: str | None = None) -> DataFrame:
    """T2 over a keyed table (``sources.keyed``): each micro-batch of (pk, text) appends the new vectors of its own keys as
    a delta named after the batch, so what it writes is in proportion to itself and a replayed batch replaces its own
    delta. Returns the table with the deltas laid over it; ``keyed.compact`` moves them into the table."""
    cfg = {text_col: dict(TEXT_DEFAULTS)}

    def per_batch(batch: DataFrame, epoch: int) -> None:
        vectors = text_transform(batch.select(*pk, text_col), pk, cfg, dim=dim).withColumnRenamed(text_col, vec_col)
        keyed.append_delta(vectors, base, pk, vec_col, epoch + 1)

    stream = _file_stream(spark, source, schema, glob).load()
    if prepare is not None:
        stream = prepare(stream)
    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return keyed.read_merged(spark, base, pk, vec_col)


def _file_stream(spark: SparkSession, folder: str, schema, glob: str | None):
    r = spark.readStream.format("parquet").schema(schema).option("path", folder)
    return r.option("pathGlobFilter", glob) if glob else r


def _version_before(spark: SparkSession, base: str, number: int | None = None) -> str:
    """Path of the newest complete version (below ``number``)."""
    p = _path(spark, base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v=")]
    done = [n for n in sorted(names) if (number is None or int(n[2:]) < number) and _exists(spark, os.path.join(base, n, "_SUCCESS"))]
    if not done:
        raise FileNotFoundError(f"no complete version under {base}")
    return os.path.join(base, done[-1])
