"""Frames of a stream of samples as they arrive (Structured Streaming).

A micro-batch's samples are added to what a stream holds; every full frame leaves with the transient state of its stream. Samples of one
stream must arrive in the order of their numbers within a batch or across batches; a number that was passed already is late and dropped.
A gap is silence; of a gap of more than MOST samples only the frame that it begins in is filled up and the next is the one that the new sample lies in.
The batch operators give the same frames for the same samples. Watermarks are the caller's choice and not part of the semantics.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "stream_id long, frame_no long, energy double, jump boolean"
STATE = "next long, held array<double>, frame_no long, last double"
#: Samples of a gap that is filled with silence.
MOST = 1 << 20


def frame_stream(samples: DataFrame, size: int, limit: float = 3.0, most: int = MOST) -> DataFrame:
    """stream_id, frame_no, energy, jump of every full frame; samples: stream_id, n (from 0), value."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, held, frame, last = state.get if state.exists else (0, [], 0, -1.0)
        held, out = list(held), []
        rows = pd.concat(list(batches)).sort_values("n", kind="stable").drop_duplicates("n")

        def cut() -> None:
            nonlocal held, frame, last
            while len(held) >= size:
                energy = sum(x * x for x in held[:size])
                out.append((key[0], frame, energy, last >= 0 and abs(energy - last) > limit * min(energy, last)))
                held, frame, last = held[size:], frame + 1, energy

        for v in rows.loc[rows["n"] >= at, ["n", "value"]].itertuples(index=False):
            gap = int(v.n - at)
            if gap > most:
                held += [0.0] * (-len(held) % size)
                cut()
                frame, at = int(v.n) // size, int(v.n) // size * size
                gap, last = int(v.n) - at, 0.0
            held += [0.0] * gap
            held.append(0.0 if pd.isna(v.value) else float(v.value))
            at = int(v.n) + 1
        cut()
        state.update((at, held, frame, last))
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "frame_no", "energy", "jump"])

    return samples.groupBy("stream_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def window_energy(events: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, energy, n of tumbling event-time windows; rows later than `late` are dropped by the watermark."""
    from pyspark.sql import functions as F

    grouped = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", length).alias("w"))
    return grouped.agg(F.sum(F.col("value") * F.col("value")).alias("energy"), F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "energy", "n")
