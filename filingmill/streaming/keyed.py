"""Keyed state with a lifetime: first arrivals and cached results, kept by Spark in its state store instead of being read back from a table.

Both need the RocksDB state store (`keyed_state`). With a lifetime Spark looks at the clock in batch after batch, so such a stream
is run with a processing-time trigger, or once=True for what is there; without one, availableNow ends too. A key's state is one small value that goes when its lifetime is over, so state grows
with the keys of that time only. After a restart Spark restores it from the checkpoint, with the output that it belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> SparkSession:
    """A session like this one, with a state store that keyed state can use; this one stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


def _milliseconds(lifetime: timedelta | None) -> int | None:
    return None if lifetime is None else int(lifetime.total_seconds() * 1000)


def _mode(lifetime: timedelta | None) -> str:
    return "None" if lifetime is None else "ProcessingTime"


class FirstArrival(StatefulProcessor):
    """Emits the first row of a key, by `seq` within a batch, and nothing of it after that while its state lives."""

    def __init__(self, seq: str, lifetime: timedelta | None):
        self.seq, self.lifetime = seq, lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.met = handle.getValueState("met", "seen boolean", _milliseconds(self.lifetime))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if len(part):
                least = part.loc[[part[self.seq].idxmin()]]
                first = least if first is None or least[self.seq].iloc[0] < first[self.seq].iloc[0] else first
        if first is not None and not self.met.exists():
            self.met.update((True,))
            yield first

    def close(self) -> None:
        pass


def first_arrivals(feed: DataFrame, key: list[str], seq: str, lifetime: timedelta | None = None) -> DataFrame:
    """The stream's rows whose key hasn't come before, within the lifetime of what is remembered (None: for ever). feed: of a session from keyed_state."""
    return feed.groupBy(*key).transformWithStateInPandas(FirstArrival(seq, lifetime), feed.schema, "Append", _mode(lifetime))


class Cached(StatefulProcessor):
    """A key's last stored result with its extractor version; lookups of another version miss."""

    def __init__(self, lifetime: timedelta | None):
        self.lifetime = lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "version string, payload string", _milliseconds(self.lifetime))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        out, changed = [], False
        for seq, version, payload in pd.concat(list(rows)).sort_values("seq")[["seq", "extractor_version", "payload"]].itertuples(index=False):
            if payload is None or payload != payload:
                hit = held is not None and held[0] == version
                out.append((key[0], seq, version, hit, held[1] if hit else None))
            else:
                held, changed = (version, payload), True
        if changed:
            self.held.update(held)
        if out:
            yield pd.DataFrame(out, columns=["file_hash", "seq", "extractor_version", "hit", "payload"])

    def close(self) -> None:
        pass


def cached_lookups(feed: DataFrame, lifetime: timedelta | None = None) -> DataFrame:
    """feed (file_hash, seq, extractor_version, payload) -> (file_hash, seq, extractor_version, hit, payload) of the rows without a payload.

    A row with one stores it as its hash's result, in place of the last; one without asks for it. Rows count in the order of seq
    within a batch. A result of another version, or whose lifetime is over, is a miss.
    """
    out = f"file_hash {feed.schema['file_hash'].dataType.simpleString()}, seq {feed.schema['seq'].dataType.simpleString()}, extractor_version string, hit boolean, payload string"
    return feed.select("file_hash", "seq", "extractor_version", "payload").groupBy("file_hash").transformWithStateInPandas(Cached(lifetime), out, "Append", _mode(lifetime))
