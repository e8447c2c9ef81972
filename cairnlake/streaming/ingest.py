"""Incremental ingest with Structured Streaming.

Each micro-batch is planned, its objects are put with insert-ignore and its cache rows
upserted, and the store is committed once; a commit writes what the batch adds. A replayed batch changes nothing: objects
are known by content, and equal cache rows overwrite each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairnlake.operators import pipeline as P
from cairnlake.operators.store import Store, unix_timestamp
from cairnlake.runtime import materialize


def put_files(store: Store, files: DataFrame, config: P.Config = P.Config(), now: int | None = None) -> Store:
    """``store`` with the files' chunks, recipes and cache rows, put at ``now`` (seconds since 1970)."""
    now = unix_timestamp() if now is None else now
    plans = materialize(P.plan_files(files, config), "ingest")
    cache = plans.select(F.col("original_hash").alias("file_hash"), "recipe_hash", F.lit(now).cast("long").alias("updated_at"), "file_id")
    return store.put_objects(P.plan_objects(plans, now), F.col("input_ordinal")).put_cache(cache, ["updated_at", "file_id"])


def ingest_stream(files: DataFrame, path: str, checkpoint: str, namespace: str | None = None, config: P.Config = P.Config(), compact_after: int = 1000) -> StreamingQuery:
    """Start ingesting a streaming DataFrame (file_id, bytes, extension) into the store in ``path``, all that is available.

    After so many commits the store is written as one, so that readers do not meet ever more files.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark: SparkSession = rows.sparkSession
        store = put_files(Store.open(spark, path, namespace), rows, config).commit()
        if len(store.commits) >= compact_after:
            store.compact()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
