"""The streaming twin of ``operators.causal``: state for each actor and each host, in order of event time.

Repeated alerts go within the watermark's delay. An actor's alerts wait until the watermark has passed them, then they
are taken in order, so files may bring them in any order and the features still equal the batch ones; what comes later
than the delay is dropped by Spark. Pairs of processes of a host follow in a second operator, which gets alerts when they are final.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from factloom.functions.lineage import shared_path
from factloom.operators.causal import BANDS, CHAIN, DAY, DISCOVERY, ESCALATION, WEEK, feature_names, guarded, identified, listed

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PENDING = "event_id long, us long, host string, techniques array<string>, tactics array<string>, parent string, image string, band long, missing int, fallback int"
_BETWEEN = "event_id long, us long, host string, parent string, image string, values array<double>"
_OUT = "event_id long, values array<double>"
#: A null value within a key of state.
_NONE = "\x00"


class _Recent:
    """Times in order, with a value each, and how often each value is there; what is too old goes once, so a hot key takes time in proportion to its rows."""

    def __init__(self, times: list[int] = (), values: list[str] | None = None) -> None:
        self.rows = deque(zip(times, values or [""] * len(times), strict=True))
        self.values = Counter(v for _, v in self.rows)

    def __bool__(self) -> bool:
        return True

    def add(self, us: int, value: str = "") -> None:
        self.rows.append((us, value))
        self.values[value] += 1

    def since(self, us: int) -> int:
        """How many are left when those before ``us`` go."""
        while self.rows and self.rows[0][0] < us:
            _, value = self.rows.popleft()
            self.values[value] -= 1
            if not self.values[value]:
                del self.values[value]
        return len(self.rows)

    def row(self) -> tuple[list[int]]:
        return ([us for us, _ in self.rows],)

    def pairs(self) -> tuple[list[int], list[str]]:
        return [us for us, _ in self.rows], [v for _, v in self.rows]


class ActorHistory(StatefulProcessor):
    """Counts, novelty, habits and chains of one actor.

    Only entries that a batch touches are read and written. Trailing times older than ``ttl`` milliseconds
    go by themselves, where a stream is live; 0 keeps them.
    """

    def __init__(self, mode: str, ttl: int = 0) -> None:
        self.mode, self.ttl = mode, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.here = handle.getMapState("here", "host string, technique string", "times array<long>")
        self.anywhere = handle.getMapState("anywhere", "technique string", "times array<long>", self.ttl or None)
        self.hosts = handle.getMapState("hosts", "host string", "since long")
        self.chain = handle.getMapState("chain", "host string", "times array<long>, tactics array<string>", self.ttl or None)
        self.bands = handle.getValueState("bands", "counts array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        names = [c.split()[0] for c in _PENDING.split(", ")]
        found = []
        for batch in rows:
            for r in batch.loc[batch["event_id"].notna(), names].itertuples(index=False, name=None):
                event, us, host, techniques, tactics, parent, image, band, missing, fallback = (None if v is pd.NA or v is pd.NaT else v for v in r)
                found.append((int(event), int(us), host, list(techniques), list(tactics), parent, image, int(band), int(missing), int(fallback)))
        if found:
            self.pending.appendList(found)
            first = min(r[1] for r in found) // 1000 + 1
            waiting = list(self.handle.listTimers())
            if not waiting or first < min(waiting):
                for t in waiting:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.pending.get(), key=lambda r: (r[1], r[0]))
        ready, rest = [r for r in rows if r[1] // 1000 < now], [r for r in rows if r[1] // 1000 >= now]
        if rest:
            self.pending.put(rest)
            self.handle.registerTimer(rest[0][1] // 1000 + 1)
        else:
            self.pending.clear()
        yield pd.DataFrame(self._folded(ready), columns=[c.split()[0] for c in _BETWEEN.split(", ")])

    def _folded(self, rows: list[tuple]) -> list[tuple]:
        counts = list(self.bands.get()[0]) if self.bands.exists() else None
        old = counts is not None  # a new actor has no entries to ask for
        cache: dict[tuple, object] = {}
        touched: dict[tuple, tuple] = {}

        def entry(state, key: tuple, made):
            """The entry, made of its value, or None; read once in a call."""
            at = (id(state), key)
            if at not in cache:
                cache[at] = made(*state.getValue(key)) if old and state.containsKey(key) else None
            return cache[at]

        def kept(state, key: tuple, made, value):
            """The entry, or a new one; written in the end."""
            at = (id(state), key)
            if cache.get(at) is None:
                cache[at] = made()
            touched[at] = (state, key, value)
            return cache[at]

        out = []
        for event, us, host, techniques, tactics, parent, image, band, missing, fallback in rows:
            techniques, tactics = ([_NONE if v is None else v for v in x] for x in (techniques, tactics))
            keep = slice(0, 1) if self.mode == "first_only" else slice(None)
            read = slice(None) if self.mode == "aggregate" else slice(0, 1)
            days, weeks, new = [], [], []
            for t in techniques:
                near, wide = entry(self.here, (host, t), _Recent), entry(self.anywhere, (t,), _Recent)
                days.append(near.since(us - DAY) if near else 0)
                weeks.append(wide.since(us - WEEK) if wide else 0)
                new.append(near is None)
            chain = entry(self.chain, (host,), _Recent)
            if chain:
                chain.since(us - CHAIN)
            live = chain.values if chain else {}
            total, same = (sum(counts), counts[band]) if counts else (0, 0)
            up = any(t in ESCALATION for t in tactics[read]) and DISCOVERY in live
            first = entry(self.hosts, (host,), int) is None
            values = [min(days[read]), min(weeks[read]), max(new[read]), first, counts is None, (same + 1) / (total + BANDS), same == 0, len(live.keys() | set(tactics[read])), up, missing, fallback, len(techniques)]
            out.append((event, us, host, parent, image, [float(v) for v in values]))
            for t in techniques[keep]:
                kept(self.here, (host, t), _Recent, _Recent.row).add(us)
                kept(self.anywhere, (t,), _Recent, _Recent.row).add(us)
            for t in tactics[keep]:
                kept(self.chain, (host,), _Recent, _Recent.pairs).add(us, t)
            if first:
                kept(self.hosts, (host,), lambda us=us: us, lambda since: (since,))
            counts = counts or [0] * BANDS
            counts[band] += 1
        for at, (state, key, value) in touched.items():
            state.updateValue(key, value(cache[at]))
        if rows:
            self.bands.update((counts,))
        return out

    def close(self) -> None:
        pass


class PairHistory(StatefulProcessor):
    """Whether a host has had a pair of parent and child process; alerts come when they are final, so batches are in order.

    Only the first alert of a batch can be new, so no more than that one is held.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.since = handle.getValueState("since", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.since.exists()
        least = None
        for batch in rows:
            own = list(zip(batch["us"], batch["event_id"], batch["values"], strict=True))
            if not known:
                first = min(own if least is None else [least, *own], key=lambda r: r[:2])
                own = [r for r in (own if least is None else [least, *own]) if r is not first]
                least = first
            if own:
                yield self._told(own, 0.0)
        if least is not None:
            self.since.update((int(least[0]),))
            yield self._told([least], 1.0)

    def _told(self, rows: list[tuple], new: float) -> pd.DataFrame:
        return pd.DataFrame({"event_id": [int(event) for _, event, _ in rows], "values": [[*values[:9], new, *values[9:]] for _, _, values in rows]})

    def close(self) -> None:
        pass


def stream_features(alerts: DataFrame, mode: str = "aggregate", delay: str = "10 minutes", excluded: list[str] | None = None, ttl: int = 0) -> DataFrame:
    """(event_id, features) of a stream of alerts, each once the watermark has passed it; Spark's state must be kept by RocksDB."""
    names = feature_names(mode)
    rows = listed(identified(guarded(alerts, excluded or []))).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    rows = rows.select("event_id", "us", "host", "techniques", "tactics", "parent", "image", "band", F.col("actor_identity_missing_subject").alias("missing"), F.col("actor_identity_host_fallback").alias("fallback"), "ts", "actor")
    between = rows.groupBy("actor").transformWithStateInPandas(ActorHistory(mode, ttl), _BETWEEN, "Append", "EventTime")
    pairs = between.withColumns({c: F.coalesce(c, F.lit(_NONE)) for c in ("host", "parent")})
    out = pairs.groupBy("host", "parent", "image").transformWithStateInPandas(PairHistory(), _OUT, "Append", "None")
    value = lambda k, n: F.round(F.element_at("values", k + 1), 6) if n == "actor_time_typicality" else F.element_at("values", k + 1).cast("long")
    return out.select("event_id", *(value(k, n).alias(n) for k, n in enumerate(names)))


def replayed(spark: SparkSession, path: str, alerts_of, mode: str = "aggregate", delay: str = "10 minutes", excluded: list[str] | None = None) -> DataFrame:
    """Features of all alerts of a table, read as a stream in one batch together with one row of a far later time, which lets them all pass in the batch after.

    ``alerts_of`` turns rows of the table into alerts, and a row of nulls but for its time into one without an id.
    """
    folder = shared_path(spark, "stream")
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    end = spark.range(1).select(*(F.lit("2200-01-01").cast(f.dataType).alias(f.name) if f.dataType.typeName().startswith("timestamp") else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    end.write.parquet(f"{folder}/end")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    try:
        source = spark.readStream.schema(schema)
        # a stream reads folders, so a single file is named by a filter
        rows = source.parquet(path) if whole else source.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
        both = rows.unionByName(spark.readStream.schema(schema).parquet(f"{folder}/end"))
        own = stream_features(alerts_of(both), mode, delay, excluded)
        run = own.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{folder}/rows")
