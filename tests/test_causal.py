"""Causal features in batch and as a stream against one pass over ordered rows."""

import random

import pytest
from pyspark.errors import PySparkException

from factloom.operators import causal
from factloom.streaming.causal import _ROCKS, ActorHistory, stream_features

SCHEMA = "event_id long, us long, node string, category string, subject_user string, subject_domain string, event_user string, host string, techniques array<string>, tactics array<string>, parent string, image string"
TACTICS = ("Discovery", "Execution", "Credential Access", None)
START = 1_700_000_000_000_000


def alerts(seed, n=160):
    rng = random.Random(seed)
    rows, us = [], START
    for k in range(n):
        us += rng.choice([0, 1, 60_000_000, 400_000_000, 900_000_000, 4 * causal.HOUR, 30 * causal.HOUR])
        user = rng.choice(["ann", "ann", "bob", " ", None])
        rows.append((k, us, "main", "process_creation", user, rng.choice(["D", "", None]), rng.choice(["D\\eve", "zed", "D\\", "\t", None]), rng.choice(["h1", "h2"]), rng.choice([["T1"], ["T1", "T2"], ["T2", None, "T2"], [], None]), [rng.choice(TACTICS) for _ in range(rng.choice([1, 1, 2, 3]))], rng.choice(["p", "q", None]), rng.choice(["i", "j", None])))
    return rows


def brute(rows, mode):
    past, out = [], {}
    distinct = lambda values: list(dict.fromkeys(v for v in values or () if v is not None)) or [None]
    for event, us, _, _, subject, domain, other, host, techniques, tactics, parent, image in sorted(rows, key=lambda r: (r[1], r[0])):
        usable = lambda v: isinstance(v, str) and v.strip() != ""
        left, _, right = (other or "").partition("\\")
        name, where = (right, left) if "\\" in (other or "") else (other, None)
        missing = not usable(subject)
        if not missing:
            actor = (subject, domain if usable(domain) else None)
        elif usable(other) and usable(name):
            actor = (name, where or None)
        else:
            actor = (f"(host:{host})", None)
        second = missing and actor[0] != f"(host:{host})"
        techniques, tactics, image = distinct(techniques), distinct(tactics), image or causal.NO_IMAGE
        read = slice(None) if mode == "aggregate" else slice(0, 1)
        keep = slice(0, 1) if mode == "first_only" else slice(None)
        band = (us // 1_000_000 // 3600 % 24) // 6 + 4 * ((us // 1_000_000 // 86400 + 4) % 7 in (0, 6))
        mine = [p for p in past if p["actor"] == actor]
        near = [p for p in mine if p["host"] == host and us - p["us"] <= causal.CHAIN]
        days = [sum(p["host"] == host and t in p["techniques"] and us - p["us"] <= causal.DAY for p in mine) for t in techniques[read]]
        weeks = [sum(t in p["techniques"] and us - p["us"] <= causal.WEEK for p in mine) for t in techniques[read]]
        new = [not any(p["host"] == host and t in p["techniques"] for p in mine) for t in techniques[read]]
        live = {t for p in near for t in p["tactics"]}
        same = sum(p["band"] == band for p in mine)
        values = [min(days), min(weeks), max(new), not any(p["host"] == host for p in mine), not mine, int((same + 1) / (len(mine) + 8) * 1e6 + 0.5) / 1e6, same == 0, len(live | set(tactics[read])), "Discovery" in live and any(t in causal.ESCALATION for t in tactics[read]), not any(p["host"] == host and (p["parent"], p["image"]) == (parent, image) for p in past), missing, missing and not second, len(techniques)]
        out[event] = [float(v) for v in values][: len(causal.feature_names(mode))]
        past.append({"us": us, "actor": actor, "host": host, "techniques": techniques[keep], "tactics": tactics[keep], "band": band, "parent": parent, "image": image})
    return out


def collected(df):
    return {r[0]: [float(v) for v in r[1:]] for r in df.collect()}


@pytest.mark.parametrize("mode", causal.MODES)
def test_batch_equals_one_pass(spark, mode):
    rows = alerts(causal.MODES.index(mode))
    got = causal.features(spark.createDataFrame(rows, SCHEMA).repartition(3), mode)
    assert got.columns == ["event_id", *causal.feature_names(mode)]
    assert collected(got) == brute(rows, mode)


def test_stream_in_any_order_with_repeats_and_a_restart(spark, tmp_path):
    rows = alerts(9, 120)
    end = [(None, START + 10**15, "main", "process_creation", *[None] * 8)]
    rng = random.Random(1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    try:
        for k in range(0, 160, 40):
            own = rows[k : k + 40] + rows[max(0, k - 3) : k] if k < 120 else end
            own = rng.sample(own, len(own))
            spark.createDataFrame(own, SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / f"{k:04}"))
            stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
            found = stream_features(stream, "aggregate", "400 days", ["collector"])
            run = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == len(rows) and collected(out) == brute(rows, "aggregate")


class Steps(int):
    """A time that counts how often it is compared or subtracted from."""

    taken = 0

    def __sub__(self, other):
        Steps.taken += 1
        return int(self) - int(other)

    def __lt__(self, other):
        Steps.taken += 1
        return int(self) < int(other)


def test_a_hot_actor_takes_time_in_proportion_to_its_alerts():
    class Fresh:
        exists = containsKey = lambda self, *key: False
        updateValue = update = lambda self, *value: None

    history = ActorHistory("aggregate")
    for name in ("here", "anywhere", "hosts", "chain", "bands"):
        setattr(history, name, Fresh())
    n = 1500
    out = history._folded([(k, Steps(START + k), "h", ["T1", "T2"], ["Discovery"], "p", "i", 0, 0, 0) for k in range(n)])
    assert [r[5][:2] for r in out] == [[k, k] for k in range(n)]
    assert Steps.taken < 20 * n


def test_excluded_nodes_raise_and_unknown_modes(spark):
    row = [(1, START, "collector", "process_creation", *[None] * 3, "h", None, None, None, None)]
    with pytest.raises(PySparkException, match="excluded node"):
        causal.guarded(spark.createDataFrame(row, SCHEMA), ["collector"]).collect()
    assert causal.features(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        causal.feature_names("every")
