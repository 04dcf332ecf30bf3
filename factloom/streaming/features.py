"""The streaming twin of the trailing counts: state for each actor, rows seen strictly before."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.functions.lineage import shared_path
from factloom.operators.events import HOUR, alerts

OUTPUT = "event_id long, actor long, host long, technique string, us long, freq_24h long, freq_7d long"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, expire: bool = False) -> Iterator[pd.DataFrame]:
    day, week = 24 * HOUR, 168 * HOUR
    if state.hasTimedOut:
        state.remove()
        return
    # times of the last week for each technique, and of the last day for each technique and host, oldest first
    by_kind: dict[str, deque] = defaultdict(deque)
    by_host: dict[tuple, deque] = defaultdict(deque)
    for us, host, kind in zip(*(state.get if state.exists else ([], [], [])), strict=True):
        by_kind[kind].append((us, host))
        by_host[kind, host].append(us)
    # Spark cuts an actor's rows into several batches, which are in no order among themselves
    rows = pd.concat([*batches]).sort_values(["us", "event_id"])
    found = []
    for row in rows.itertuples(index=False):
        kind, host = by_kind[row.technique], by_host[row.technique, row.host]
        while kind and row.us - kind[0][0] > week:
            kind.popleft()
        while host and row.us - host[0] > day:
            host.popleft()
        found.append((row.event_id, key[0], row.host, row.technique, row.us, len(host), len(kind)))
        kind.append((row.us, row.host))
        host.append(row.us)
    yield pd.DataFrame(found, columns=[c.split()[0] for c in OUTPUT.split(", ")])
    past = sorted((us, host, kind) for kind, own in by_kind.items() for us, host in own)
    state.update(tuple(list(x) for x in zip(*past, strict=True)) if past else ([], [], []))
    if expire:
        state.setTimeoutDuration(7 * 24 * 3600 * 1000)


def stream_frequencies(rows: DataFrame, expire: bool = False) -> DataFrame:
    """Trailing counts of a stream of (event_id, us, actor, host, technique), in time order across batches.

    State holds an actor's last seven days; with ``expire``, for streams that don't end, it goes after
    seven days without a row of the actor. Feed each batch in order; the counts then equal the batch windows.
    """
    return rows.groupBy("actor").applyInPandasWithState(partial(_fold, expire=expire), OUTPUT, "times array<long>, hosts array<long>, kinds array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def streamed_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, freq_24h, freq_7d) of an events table read as a stream until all that is there is done; written to the shared folder, read back."""
    folder = shared_path(spark, "stream")
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    source = spark.readStream.schema(schema)
    # a stream reads folders, so a single file is named by a filter
    rows = source.parquet(path) if whole else source.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    own = stream_frequencies(alerts(rows))
    run = own.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("event_id", "freq_24h", "freq_7d")
