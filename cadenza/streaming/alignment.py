"""Alignment of live series: the streaming twin of align.align(), cells going out as soon as they are settled."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.functions.ordered import KEY
from cadenza.operators.align import GAP_FILL, MOST_CELLS


class Series:
    """What is known of one live series; all of it can be put into JSON.

    `waiting` holds samples that the watermark hasn't passed yet, `kept` those in order of which cells are still to come, `done` is
    the last cell given out and `anchors` each signal's last value up to it.
    """

    def __init__(self, signals: Sequence[str], gap_fill: int, saved: str | None = None) -> None:
        self.signals, self.gap_fill = list(signals), gap_fill
        content = json.loads(saved) if saved else {"waiting": [], "kept": [], "first": None, "last": None, "done": None, "anchors": [None] * len(self.signals), "latest": None}
        self.__dict__.update(content)

    def saved(self) -> str:
        return json.dumps({k: getattr(self, k) for k in ("waiting", "kept", "first", "last", "done", "anchors", "latest")})

    def add(self, at: float, index: int, t: float | None, values: list[float | None]) -> None:
        self.waiting.append([at, index, t, values])
        self.latest = at if self.latest is None else max(self.latest, at)

    def settle(self, until: float | None) -> None:
        """Take in the samples up to a time, all for None, in order; those whose time doesn't advance are dropped."""
        ready = sorted((x for x in self.waiting if until is None or x[0] <= until), key=lambda x: x[1])
        self.waiting = [x for x in self.waiting if until is not None and x[0] > until]
        for _, _, t, values in ready:
            if t is None or not math.isfinite(t):
                continue
            t = math.floor(t + 0.5)
            if self.last is None:
                self.first, self.done = t, t - 1
            if (self.last is None or t > self.last) and t - self.first < MOST_CELLS:
                self.last = t
                self.kept.append([t, [v if v is not None and math.isfinite(v) else None for v in values]])

    def horizon(self) -> int:
        """The last cell that no later sample can change: the newest sample's own still lacks the gap after it, and a signal's
        cells after its last value hang on its next one for as long as a gap up to there would be filled."""
        upto = self.last - 1
        for k in range(len(self.signals)):
            own = max((t for t, values in self.kept if values[k] is not None), default=None)
            own = self.anchors[k][0] if own is None and self.anchors[k] else own
            if own is None:
                return self.done  # its first value goes to all cells before
            if self.last - own <= self.gap_fill:
                upto = min(upto, own)
        return upto

    def cells(self, closing: bool) -> list[tuple]:
        """(i, offset, valid, gap, values..., known...) of the cells that are settled, all of them when closing."""
        if self.last is None:
            return []
        upto = self.last if closing else self.horizon()
        out, at = [], 0
        follow = [[(t, values[k]) for t, values in self.kept if values[k] is not None] for k in range(len(self.signals))]
        place = [0] * len(self.signals)
        for c in range(self.done + 1, upto + 1):
            while at + 1 < len(self.kept) and self.kept[at + 1][0] <= c:
                at += 1
            t = self.kept[at][0]
            after = self.kept[at + 1][0] if at + 1 < len(self.kept) else None
            gap = after - t - 1 if after is not None else None
            values, known = [], []
            for k in range(len(self.signals)):
                while place[k] < len(follow[k]) and follow[k][place[k]][0] <= c:
                    self.anchors[k] = list(follow[k][place[k]])
                    place[k] += 1
                p, q = self.anchors[k], follow[k][place[k]] if place[k] < len(follow[k]) else None
                if p is None:
                    value = q[1] if q else 0.0
                elif q is None or c == p[0] or q[0] - p[0] - 1 > self.gap_fill:
                    value = p[1]
                else:
                    value = p[1] + (q[1] - p[1]) * (c - p[0]) / (q[0] - p[0])
                values.append(value)
                known.append(p is not None and p[0] == c)
            valid = c == t or (gap is not None and gap <= self.gap_fill)
            out.append((c - self.first, self.first, valid, gap if c == t else None, *values, *known))
        self.done = max(self.done, upto)
        self.kept = self.kept[at:] if out else self.kept
        return out


def aligned_stream(samples: DataFrame, signals: Sequence[str], lateness: str = "10 seconds", quiet: float = 60.0, gap_fill: int = GAP_FILL) -> DataFrame:
    """(activity_id, i, offset, valid, gap, signals..., known_<signal>...): the cells that align.align() gives, from a stream of
    (activity_id, at timestamp, sample_idx, t, signals...), in append mode.

    `at` rises with sample_idx within a series. Samples may arrive in any order up to `lateness`; later ones are left out. A
    sample is taken in once the watermark passes it, a cell given out once no later sample can change it; those before a
    signal's first value wait for that. A series ends when the watermark is `quiet` seconds past its newest sample: its last
    cells go out and its state is dropped. Until then the state holds the samples of cells still to come. A series of more than
    86,400 cells is cut off there, where align() leaves it out, as its first cells are gone by then.
    """
    kinds = ", ".join([f"`{s}` double" for s in signals] + [f"`known_{s}` boolean" for s in signals])
    schema = f"{KEY} string, i bigint, offset bigint, valid boolean, gap bigint, {kinds}"
    names = [KEY, "i", "offset", "valid", "gap", *signals, *[f"known_{s}" for s in signals]]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        series = Series(signals, gap_fill, state.get[0] if state.exists else None)
        closing = state.hasTimedOut
        for batch in batches:
            for at, index, t, *values in batch[["at", "sample_idx", "t", *signals]].itertuples(index=False, name=None):
                series.add(at.timestamp(), int(index), None if t is None or t != t else float(t), [None if v is None or v != v else float(v) for v in values])
        mark = state.getCurrentWatermarkMs() / 1000
        series.settle(None if closing else mark)
        cells = series.cells(closing)
        if closing:
            state.remove()
        else:
            state.update((series.saved(),))
            # a timer can't be set before the watermark
            state.setTimeoutTimestamp(int(max(series.latest + quiet, mark + 0.001) * 1000))
        if cells:
            yield pd.DataFrame([(key[0], *c) for c in cells], columns=names).astype({"gap": "Int64"})

    rows = samples.withWatermark("at", lateness).select(KEY, "at", "sample_idx", "t", *signals)
    return rows.groupBy(KEY).applyInPandasWithState(step, schema, "series string", "append", GroupStateTimeout.EventTimeTimeout)
