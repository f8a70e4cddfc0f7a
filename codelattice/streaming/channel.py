"""A buffered log channel: entries wait until there are enough, or time is up, and come back if they could not be sent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a full buffer, milliseconds between flushes, entries that come back after a failure, and the buffer from which on none do.
FULL, EVERY_MS, REQUEUED, CROWDED = 20, 2000, 50, 100


@dataclass
class Buffer:
    """The entries that wait in one channel, the time of the next flush, and the number of the last."""

    entries: list = field(default_factory=list)
    due: int | None = None
    flushes: int = 0

    def flush(self, at: int, fails: bool) -> tuple | None:
        """Send what waits: (number, time, entries, first, last, sent, requeued). After a failure the last entries come back to the front."""
        if not self.entries:
            return None
        logs, self.entries = self.entries, []
        self.flushes += 1
        back = logs[-REQUEUED:] if fails and len(self.entries) < CROWDED else []
        self.entries = back + self.entries
        return (self.flushes, at, len(logs), logs[0], logs[-1], not fails, len(back))

    def until(self, at: int, fails) -> Iterator[tuple]:
        """The timed flushes up to a time; the timer starts with the channel's first entry."""
        if self.due is None:
            self.due = at + EVERY_MS
        while self.due <= at:
            if not self.entries:  # nothing happens until an entry comes
                self.due += (at - self.due) // EVERY_MS * EVERY_MS + EVERY_MS
                break
            if (out := self.flush(self.due, fails(self.due))) is not None:
                yield out
            self.due += EVERY_MS

    def add(self, entry, at: int, fails) -> Iterator[tuple]:
        yield from self.until(at, fails)
        self.entries.append(entry)
        if len(self.entries) >= FULL and (out := self.flush(at, fails(at))) is not None:
            yield out


def buffered_flushes(entries: DataFrame, outages: list[tuple[int, int]] = ()) -> DataFrame:
    """(channel, flush, at_ms, n, first, last, sent, requeued): how the channels of a log flush, from (channel, id, at_ms) entries.

    A channel flushes when it holds FULL entries and every EVERY_MS from its first entry on; what is left at its end is sent then. Flushes within one of
    the ``outages`` (from, to; in milliseconds) fail: their last REQUEUED entries go back to the front. Entries are taken by time, then
    id. Channels are dealt over tasks and each is one pass that holds its buffer only.
    """
    fails = lambda at: any(a <= at < b for a, b in outages)
    kind, key = dict(entries.dtypes)["id"], dict(entries.dtypes)["channel"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel, buffer, columns = None, Buffer(), ["channel", "flush", "at_ms", "n", "first", "last", "sent", "requeued"]

        def rest() -> list[tuple]:
            out = buffer.flush(buffer.due, False) if channel is not None and buffer.entries else None
            return [(channel, *out)] if out else []

        for rows in batches:
            out = []
            for c, i, at in zip(rows["channel"].tolist(), rows["id"].tolist(), rows["at_ms"].tolist(), strict=True):
                if c != channel:
                    out += rest()
                    channel, buffer = c, Buffer()
                out += [(channel, *x) for x in buffer.add(i, at, fails)]
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(rest(), columns=columns)

    ordered = entries.where("channel is not null and at_ms is not null").select("channel", "id", F.col("at_ms").cast("long").alias("at_ms")).repartition("channel").sortWithinPartitions("channel", "at_ms", "id")
    return ordered.mapInPandas(run, f"channel {key}, flush int, at_ms long, n int, first {kind}, last {kind}, sent boolean, requeued int")
