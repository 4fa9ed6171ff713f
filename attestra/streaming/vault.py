"""Streaming forms of the vault's incremental rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import urls as U


def fresh_pages(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Newest record of each canonical address within the watermark; update mode."""
    rows = stream.withColumn("url", U.canonical(F.col("istenen_url"))).withColumn("t", F.timestamp_seconds("fetched_at")).withWatermark("t", delay)
    return rows.where("ok and url <> ''").groupBy("url").agg(F.max_by(F.struct("kayit_no", "fetched_at"), F.col("fetched_at")).alias("r")).select("url", "r.kayit_no", "r.fetched_at")


def once_within_ttl(stream: DataFrame, ttl: str = "6 hours") -> DataFrame:
    """The first fetch of each address within the cache's time to live; repeats are dropped."""
    rows = stream.withColumn("url", U.canonical(F.col("istenen_url"))).withColumn("t", F.timestamp_seconds("fetched_at"))
    return rows.where("url <> ''").withWatermark("t", ttl).dropDuplicatesWithinWatermark(["url"])


def hourly_hosts(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Fetches and failures of each host by the hour; late records beyond ``delay`` are left out."""
    rows = stream.withColumn("t", F.timestamp_seconds("fetched_at")).withWatermark("t", delay)
    return rows.groupBy(F.window("t", "1 hour").alias("saat"), "host").agg(F.count("*").alias("n"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("hata"))


def upsert_batches(stream: DataFrame, path: str, checkpoint: str):
    """A query that merges each batch into the vault at ``path`` (resumable: a batch that is merged again changes nothing, and one that fails half-way leaves the version before)."""
    from ..sources.readers import vault_merge

    return stream.writeStream.foreachBatch(lambda df, _: vault_merge(df.sparkSession, path, df)).option("checkpointLocation", checkpoint)


def throttled(stream: DataFrame, gap: float = 0.5) -> DataFrame:
    """When each fetch of a host may start, ``gap`` seconds after the one before: the next free slot is kept as state."""

    def slots(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (free,) = state.get if state.exists else (0.0,)
        for pdf in frames:
            out = []
            for r in pdf.sort_values(["t", "kayit_no"]).itertuples(index=False):
                slot = max(r.t, free)
                free = slot + gap
                out.append((key[0], r.kayit_no, slot))
            yield pd.DataFrame(out, columns=["host", "kayit_no", "slot"])
        state.update((free,))

    rows = stream.select("host", "kayit_no", F.col("fetched_at").alias("t")).where("host is not null and t is not null")
    return rows.groupBy("host").applyInPandasWithState(slots, "host string, kayit_no bigint, slot double", "next double", "append", GroupStateTimeout.NoTimeout)
