"""Stateful rules on a stream of discoveries: the rule as a plain class, run over ordered events in batch or in a stream.

A rule sees the events of one key in order (time, then id) and keeps a small state. ``replay`` runs it over a table, sorting
within each key; ``stream`` runs it with ``transformWithStateInPandas``, sorting within a micro-batch. Both give the
same rows for the same order of events. ``replay`` takes a key's rows one by one and never holds them as a whole; ``stream`` holds
a key's rows of one micro-batch, which ``maxFilesPerTrigger`` bounds. All events of a key go through one task, as a rule over
their order must; a hot key is spread only by a finer key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


class Rule(Protocol):
    """``event`` returns output values and the next state; a state is JSON-able."""

    outputs: str

    def start(self) -> Any: ...

    def event(self, state: Any, at: float, row: Any) -> tuple[tuple, Any]: ...


class FixedWindowQuota:
    """At most ``limit`` charges in a window that opens at the first charge."""

    outputs = "allowed boolean"

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def start(self):
        return None

    def event(self, state, at, row):
        if state is None or at - state[0] >= self.seconds:
            state = [at, 0]
        allowed = state[1] < self.limit
        return (allowed,), [state[0], state[1] + allowed]


class TokenBucket:
    """GCRA: a charge of n moves the arrival time by n emissions; it is allowed if that is within the burst. Gives the wait otherwise."""

    outputs = "allowed boolean, wait double"

    def __init__(self, rate: float, burst: int, cost: int = 1):
        self.emission, self.burst, self.cost = 1.0 / rate, burst, cost

    def start(self):
        return 0.0

    def event(self, state, at, row):
        following = max(state, at) + self.cost * self.emission
        most = at + self.emission * self.burst
        if following <= most + 1e-9:
            return (True, 0.0), following
        return (False, round(following - most, DIGITS)), state


class SlidingLimit:
    """At most ``limit`` allowed attempts in any ``seconds``; ``outcome`` of an attempt may shut its key for a while."""

    outputs = "allowed boolean"
    PENALTY = {"refused": 180, "timeout": 180, "error": 600}  # fixed values

    def __init__(self, limit: int = 10, seconds: float = 60):
        self.limit, self.seconds = limit, seconds

    def start(self):
        return [[], 0.0]

    def event(self, state, at, row):
        recent = [t for t in state[0] if at - t < self.seconds]
        allowed = at >= state[1] and len(recent) < self.limit
        shut = state[1]
        if allowed:
            recent.append(at)
            shut = max(shut, at + self.PENALTY.get(getattr(row, "outcome", None), 0))
        return (allowed,), [recent, shut]


class Corroboration:
    """Admission by source: announce with priority; sample without; get_peers once two networks have been seen (at most 4 are kept)."""

    outputs = "admitted boolean, priority boolean, networks int, first boolean"

    def __init__(self, needed: int = 2, kept: int = 4):
        self.needed, self.kept = needed, kept

    def start(self):
        return [[], False]

    def event(self, state, at, row):
        networks, seen = state
        if row.network not in networks and len(networks) < self.kept:
            networks = [*networks, int(row.network)]
        admitted = row.source in ("announce", "sample") or len(networks) >= self.needed
        return (admitted, row.source == "announce", len(networks), not seen), [networks, True]


class Horizon:
    """Is an event the first of its key, counting anew in each generation? The previous generation still counts."""

    outputs = "fresh boolean"

    def __init__(self, seconds: float = 1800):
        self.seconds = seconds

    def start(self):
        return None

    def event(self, state, at, row):
        generation = int(at // self.seconds)
        known = state is not None and state >= generation - 1
        return (not known,), state if known else generation


class RecentPeers:
    """Peers of a key, newest first, at most ``most``, each for ``ttl`` seconds; an address is one entry."""

    outputs = "peers array<string>"

    def __init__(self, most: int = 8, ttl: float = 300):
        self.most, self.ttl = most, ttl

    def start(self):
        return []

    def event(self, state, at, row):
        live = [e for e in state if at - e[1] < self.ttl and e[0] != row.peer]
        state = ([[row.peer, at]] + live)[: self.most]
        return ([e[0] for e in state],), state


def _ordered(frame: pd.DataFrame, at: str, order: list[str]) -> pd.DataFrame:
    return frame.sort_values([at, *order], kind="stable")


def _seconds(value) -> float:
    return value.timestamp() if hasattr(value, "timestamp") else float(value)


def _apply(rule: Rule, state: Any, frame: pd.DataFrame, at: str, names: list[str]) -> tuple[pd.DataFrame, Any]:
    rows = []
    for row in frame.itertuples(index=False):
        out, state = rule.event(state, _seconds(getattr(row, at)), row)
        rows.append(out)
    result = frame.copy()
    for i, name in enumerate(names):
        result[name] = [r[i] for r in rows]
    return result, state


def _names(rule: Rule) -> list[str]:
    return [part.strip().split(" ")[0] for part in rule.outputs.split(",")]


def _schema(df: DataFrame, rule: Rule) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), rule.outputs])


def replay(df: DataFrame, keys: list[str], at: str, order: list[str], rule: Rule) -> DataFrame:
    """Every row with the rule's outputs. Rows of a key follow each other in a partition, sorted by Spark, and are streamed."""
    names, columns = _names(rule), df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for frame in frames:
            if not len(frame):
                continue
            outs = []
            for key, row in zip(frame[keys].itertuples(index=False, name=None), frame.itertuples(index=False)):
                if key != last:
                    last, state = key, rule.start()
                out, state = rule.event(state, _seconds(getattr(row, at)), row)
                outs.append(out)
            frame = frame[columns].copy()
            for i, name in enumerate(names):
                frame[name] = [o[i] for o in outs]
            yield frame

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, at, *order)
    return dealt.mapInPandas(run, _schema(df, rule))


def stream(df: DataFrame, keys: list[str], at: str, order: list[str], rule: Rule, ttl_ms: int | None = None) -> DataFrame:
    """The same on a stream; needs the RocksDB state store. State goes ``ttl_ms`` after its last change."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    names, columns = _names(rule), df.columns

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.value = handle.getValueState("state", "json string", ttlDurationMs=ttl_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            frame = _ordered(pd.concat(rows), at, order)[columns]
            state = json.loads(self.value.get()[0]) if self.value.exists() else rule.start()
            result, state = _apply(rule, state, frame, at, names)
            self.value.update((json.dumps(state),))
            yield result

        def close(self) -> None:
            pass

    return df.groupBy(*keys).transformWithStateInPandas(Processor(), outputStructType=_schema(df, rule), outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


# --- micro-batches

def first_seen_cap(admitted: DataFrame, most: int = 200) -> DataFrame:
    """Of first sightings by get_peers that are not corroborated, the first ``most`` of a batch are let in as well: a top-k."""
    waiting = admitted.where("NOT admitted AND first").orderBy("ts", "event_id").limit(most).select("event_id").withColumn("__in", F.lit(True))
    return admitted.join(F.broadcast(waiting), "event_id", "left").withColumn("admitted", F.col("admitted") | F.coalesce("__in", F.lit(False))).drop("__in")


def tumbling(df: DataFrame, at: str, width: str, *keys: str) -> DataFrame:
    return df.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sliding(df: DataFrame, at: str, width: str, slide: str, *keys: str) -> DataFrame:
    return df.groupBy(F.window(at, width, slide).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, at: str, gap: str, *keys: str) -> DataFrame:
    return df.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
