"""Stateful folds over ordered rows: the rate limiter and the state of a dialogue.

Rows are dealt by key and sorted within the partitions, and one pass folds them; a task
holds the state of one key, never all of its rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[object, tuple], tuple[object, tuple]]


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Step, schema: str) -> DataFrame:
    """One output row for each row of ``rows``: ``step(state, row)`` gives the next state and the row's result.

    A row is passed as the tuple of its values; the first column of ``rows`` is ``key``. Rows with a null key go.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if row[0] != last:
                    last, state = row[0], start()
                state, result = step(state, row)
                out.append(result)
            yield pd.DataFrame(out, columns=names)

    ordered = rows.select(key, *[c for c in rows.columns if c != key]).where(f"`{key}` IS NOT NULL")
    return ordered.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def limited(rows: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(event_id, admitted, retry_after) of (key, us, event_id): at most ``limit`` admitted rows in any window.

    A row is refused while ``limit`` admitted ones of its key are less than ``seconds`` old;
    retry_after is then the whole seconds to wait, else 0. Refused rows use up nothing.
    """
    span = seconds * 1_000_000

    def step(past: deque, row: tuple) -> tuple[deque, tuple]:
        _, us, event = row
        while past and past[0] <= us - span:
            past.popleft()
        if len(past) >= limit:
            return past, (event, 0, max(1, (span - (us - past[0])) // 1_000_000 + 1))
        past.append(us)
        return past, (event, 1, 0)

    return folded(rows.select("key", "us", "event_id"), "key", ["us", "event_id"], deque, step, "event_id long, admitted long, retry_after long")


def dialogue_states(turns: DataFrame, idle: int = 8, most: int = 16) -> DataFrame:
    """(conv_id, turn, n_active, evicted, topic) after each turn of (conv_id, turn, confirmed, entities).

    Only confirmed turns change the state: their entities become the latest, those idle for
    more than ``idle`` confirmed turns go, and beyond ``most`` the least recent go. The
    topic is the first entity of the latest confirmed turn that had any. Evictions are counted for each turn.
    """

    def step(state: tuple[dict, int, str], row: tuple) -> tuple[tuple, tuple]:
        conv, turn, confirmed, entities = row
        active, count, topic = state
        gone = 0
        if confirmed:
            count += 1
            for e in entities:
                active[e] = count
            topic = entities[0] if len(entities) else topic
            keep = sorted((e for e, at in active.items() if count - at <= idle), key=lambda e: (-active[e], e))[:most]
            gone = len(active) - len(keep)
            active = {e: active[e] for e in keep}
        return (active, count, topic), (conv, turn, len(active), gone, topic)

    rows = turns.select("conv_id", "turn", "confirmed", "entities")
    return folded(rows, "conv_id", ["turn"], lambda: ({}, 0, ""), step, "conv_id long, turn long, n_active long, evicted long, topic string")
