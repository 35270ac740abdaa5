"""Frames of arriving samples with a flush: state in lists, and a timer that writes out what a stream that fell silent still holds.

Rows that come in one batch are taken in the order of their numbers; a number that was passed already is late and dropped. A stream's first frame is that of its first
sample. A gap is silence; of a gap of more than `most` samples only the frame that it begins in is filled up, so one wild number costs one frame.
When the watermark has passed a stream's last sample by `silence`, its last frame is filled with zeros, one silent frame follows, as the overlap of transforms needs, and the
state goes. The watermark policy is the caller's and not part of the frames' semantics. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "stream_id long, frame_no long, samples array<double>, flushed boolean"
#: Samples of a gap that is filled with silence.
MOST = 1 << 20


class Framer(StatefulProcessor):
    """Cuts each stream's samples into frames of `size`."""

    def __init__(self, size: int, silence_ms: int, most: int = MOST) -> None:
        self.size, self.silence_ms, self.most = size, silence_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "value double")  # samples that fill no frame yet
        self.place = handle.getValueState("place", "next long, timer long")  # number of the next sample, time of the flush

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("n", kind="stable").drop_duplicates("n")
        place = self.place.get()
        held = [v for (v,) in self.held.get()] if self.held.exists() else []
        at, timer = place if place is not None else (int(batch["n"].iloc[0]) // self.size * self.size, 0)
        out: list[tuple[int, list[float]]] = []
        for n, v in zip(batch["n"].tolist(), batch["value"].tolist(), strict=True):
            if n < at:
                continue
            if n - at > self.most:
                if held:
                    out.append((at // self.size, held + [0.0] * (self.size - len(held))))
                at, held = n // self.size * self.size, []
            held += [0.0] * (n - at)
            held.append(0.0 if v != v or v is None else float(v))
            at = n + 1
            while len(held) >= self.size:
                out.append(((at - len(held)) // self.size, held[: self.size]))
                held = held[self.size :]
        if timer:
            self.handle.deleteTimer(timer)
        timer = max(timer, int(batch["ts"].max().timestamp() * 1000) + self.silence_ms)
        self.handle.registerTimer(timer)
        self.place.update((at, timer))
        self.held.clear()
        if held:
            self.held.put([(v,) for v in held])
        yield self._rows(key, out, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [v for (v,) in self.held.get()] if self.held.exists() else []
        at = self.place.get()[0]
        out = [((at - len(held)) // self.size, held + [0.0] * (self.size - len(held)))] if held else []
        out.append((-(-at // self.size), [0.0] * self.size))
        self.held.clear()
        self.place.clear()
        yield self._rows(key, out, True)

    def _rows(self, key, out: list[tuple[int, list[float]]], flushed: bool) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["frame_no", "samples"])
        frame.insert(0, "stream_id", key[0])
        return frame.assign(flushed=flushed)

    def close(self) -> None:
        pass


def flushed_frames(samples: DataFrame, size: int, silence: int = 60_000, late: str = "1 minute", most: int = MOST) -> DataFrame:
    """stream_id, frame_no, samples, flushed; samples: a stream of stream_id, n, ts, value. silence: milliseconds of event time."""
    rows = samples.select("stream_id", "n", "ts", "value").withWatermark("ts", late)
    return rows.groupBy("stream_id").transformWithStateInPandas(Framer(size, silence, most), OUT, "Append", "EventTime")
