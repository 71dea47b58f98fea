"""A stateful processor that puts the rows of an episode in order, whatever batches they come in."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor


def rocksdb(spark: SparkSession) -> None:
    """State with several variables needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Hands the rows of an episode, in order of their steps, to ``emit`` with the rows before.

    Input rows have step_id, time (milliseconds), ends (whether the step is the last) and ``fields``. Value state: the next
    step, whether the last has come, and the latest time of a row; and ``memory``, what ``emit`` remembers. List state: the
    last rows. Map state: rows that came early, by step. A row that is still missing ``patience`` milliseconds of event time
    after a row that waits for it is given up, as a timer tells; it is left out if it comes later still, as are repeated
    rows. After the last step only a value stays, until a timer clears it.
    """

    fields = ""
    memory = ""
    start: tuple = ()
    before = 0

    def __init__(self, first: int, patience: int):
        self.first, self.patience = first, patience
        self.names = [c.split()[0] for c in self.fields.split(", ")]

    def emit(self, key: tuple, row: tuple, past: list[tuple], memo: tuple) -> tuple[Row, tuple]:
        """The result for a row, given the rows before it (the last one first), and what is remembered next."""
        raise NotImplementedError

    def kept(self, row: tuple) -> tuple:
        """What of a row is kept for the rows after it."""
        return row

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, ended boolean, latest long")
        self.memo = handle.getValueState("memo", self.memory)
        self.past = handle.getListState("before", self.fields)
        self.early = handle.getMapState("early", "step long", f"time long, ends boolean, {self.fields}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  names of the interface
        at, ended, latest = self.at.get() if self.at.exists() else (self.first, False, 0)
        for r in rows:
            if r.step_id is not None and r.step_id >= at and not ended and not self.early.containsKey((r.step_id,)):
                self.early.updateValue((r.step_id,), (r.time, r.ends, *(r[c] for c in self.names)))
                latest = max(latest, r.time)
        yield from self._go_on(key, at, ended, latest, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.at.exists():
            at, ended, latest = self.at.get()
            if ended:
                self.at.clear()
            else:
                yield from self._go_on(key, at, ended, latest, expiredTimerInfo.getExpiryTimeInMs())

    def _go_on(self, key, at: int, ended: bool, latest: int, until: int | None) -> Iterator[Row]:
        """Rows from step ``at`` on; gaps are passed where a row behind them has waited ``until`` a timer."""
        past = list(reversed([tuple(x) for x in self.past.get()])) if self.past.exists() else []
        memo = tuple(self.memo.get()) if self.memo.exists() else self.start
        waiting = {k[0]: tuple(v) for k, v in self.early.iterator()}
        while waiting and not ended:
            step = min(waiting)
            if step != at and not (until is not None and min(v[0] for v in waiting.values()) + self.patience <= until):
                break
            _, ends, *row = waiting.pop(step)
            self.early.removeKey((step,))
            out, memo = self.emit(key, tuple(row), past, memo)
            yield out
            past = [self.kept(tuple(row)), *past][: self.before]
            at, ended = step + 1, bool(ends)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.at.update((at, ended, latest))
        if ended:
            for state in (self.past, self.memo, self.early):
                state.clear()
            self.handle.registerTimer(latest + self.patience)
            return
        self.memo.update(memo)
        if past:
            self.past.put(past[::-1])
        if waiting:
            self.handle.registerTimer(min(v[0] for v in waiting.values()) + self.patience)

    def close(self) -> None:
        pass
