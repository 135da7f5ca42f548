"""A bound on what is in flight, as a stateful stream: requests wait until a worker has a slot, and timers free the slots of lost ones."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

MICROS = 1_000_000


class Slots:
    """A worker's slots and queue; times are microseconds."""

    def __init__(self, limit: int, patience: int, most_waiting: int | None, held: str | None = None):
        self.limit, self.patience, self.most_waiting = limit, patience, most_waiting
        self.flying, self.waiting = json.loads(held) if held else ([], [])

    def held(self) -> str:
        return json.dumps([self.flying, self.waiting])

    def _admit(self, now: int) -> list[tuple]:
        out = []
        while self.waiting and len(self.flying) < self.limit:
            task = self.waiting.pop(0)
            self.flying.append([task, now])
            out.append((task, now, "sent"))
        return out

    def expire(self, now: int) -> list[tuple]:
        """What is sent up to ``now`` because requests in flight were given up; the next expiry is taken first."""
        out = []
        while self.flying and (due := min(since for _, since in self.flying) + self.patience) <= now:
            self.flying = [x for x in self.flying if x[1] + self.patience > due]
            out += self._admit(due)
        return out

    def event(self, task: int, start: bool, now: int) -> list[tuple]:
        out = self.expire(now)
        if start and self.most_waiting is not None and len(self.flying) >= self.limit and len(self.waiting) >= self.most_waiting:
            return [*out, (task, now, "refused")]
        if start:
            self.waiting.append(task)
        else:
            self.flying = [x for x in self.flying if x[0] != task]
            self.waiting = [x for x in self.waiting if x != task]
        return out + self._admit(now)

    def due(self) -> int | None:
        """When a timer has something to do."""
        return min(since for _, since in self.flying) + self.patience if self.waiting and self.flying else None


def bounded(events: DataFrame, *, limit: int, patience: float, most_waiting: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """(worker, task, at, what) of a stream of events(worker, task, start, ts): when each request was sent, or that it was refused.

    ``start`` begins a request, else it ends. At most ``limit`` requests of a worker are in flight; the others wait in order of arrival, at
    most ``most_waiting`` of them. A request that has not ended after ``patience`` seconds no longer counts; that is found at the
    worker's next event or, without one, by a timer once the watermark has passed. Events of a batch are taken by time, then task.
    State is one worker's slots and queue.
    """
    micros = int(patience * MICROS)

    def step(key, frames, state):
        import numpy as np
        import pandas as pd

        slots = Slots(limit, micros, most_waiting, state.get[0] if state.exists else None)
        out = []
        if state.hasTimedOut:
            out += slots.expire(state.getCurrentWatermarkMs() * 1000)
        else:
            # Arrays, for a group has few rows and a frame's own sort takes longer than all else.
            parts = [[f[c].to_numpy() for c in ("task", "start", "micros")] for f in frames]
            rows = parts[0] if len(parts) == 1 else [np.concatenate(x) for x in zip(*parts)]
            order = np.lexsort((rows[0], rows[2]))
            for task, start, now in zip(*(x[order].tolist() for x in rows)):
                out += slots.event(task, start, now)
        state.update((slots.held(),))
        if (due := slots.due()) is not None:
            # A timer must lie beyond the watermark; what was due before it is found when it has passed on.
            state.setTimeoutTimestamp(max(-(-due // 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            task, at, what = zip(*out)
            yield pd.DataFrame({"worker": [key[0]] * len(out), "task": task, "at": at, "what": what})

    worker = events.schema["worker"].dataType.simpleString()
    timed = events.withWatermark("ts", delay).selectExpr("worker", "cast(task as bigint) as task", "start", "unix_micros(ts) as micros", "ts")
    return timed.groupBy("worker").applyInPandasWithState(step, f"worker {worker}, task bigint, at bigint, what string", "held string", "append", "EventTimeTimeout")
