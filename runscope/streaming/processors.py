"""Stateful per-session processors for ``transformWithState``.

Input rows are those of the event table.  Within a micro-batch a session's rows
are taken in event order; timers are event-time timers, which fire only as the
watermark moves on.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MARKERS = ("file_changed",)
#: A session without events for so long keeps no state.
FORGET_MS = 7 * 24 * 3600 * 1000


EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _ms(t: datetime) -> int:
    return ((t if t.tzinfo else t.replace(tzinfo=timezone.utc)) - EPOCH) // timedelta(milliseconds=1)


def _at(ms: int) -> datetime:
    return EPOCH + timedelta(milliseconds=ms)


def _ends(row) -> bool | None:
    """Whether a row ends its session (True) or begins a turn (False); None for any other."""
    if row["kind"] == "process_lifecycle" and (row["phase"] == "terminal_marker" or row["exit_code"] is not None):
        return True
    return False if row["kind"] == "turn_lifecycle" and row["phase"] == "turn_started" else None


def _ordered(rows: Iterator) -> list:
    return sorted(rows, key=lambda r: (r["event_ts"], r["source_path"] or "", r["source_offset"] or 0))


#: The columns that a processor reads besides the session; no others go to the workers, where each value of a row costs.
READS = ("event_ts", "source_path", "source_offset", "kind", "phase", "exit_code")


class _Processor(StatefulProcessor):
    """One value of a session and its one timer, whose time is kept in the value: a call to the store costs as much as many rows."""

    SCHEMA = ""
    READS = READS

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{self.SCHEMA}, timer_ms long")

    def _get(self, *default):
        *own, self.timer = self.state.get() if self.state.exists() else (*default, None)
        return own

    def _timer(self, ms: int | None) -> None:
        if self.timer is not None and ms != self.timer:
            self.handle.deleteTimer(self.timer)
        if ms is not None and ms != self.timer:
            self.handle.registerTimer(ms)

    def _keep(self, own: tuple, ms: int) -> None:
        """The session's value and its timer."""
        self._timer(ms)
        self.state.update((*own, ms))

    def _forget(self) -> None:
        """No value and no timer."""
        if self.timer is not None:
            self._timer(None)
        self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return iter(())

    def close(self) -> None:
        pass


class Lifecycle(_Processor):
    """State changes; a clean process exit ends a session once the grace period passes without a new turn.

    A session without events for FORGET_MS keeps no state; if it goes on after that, it begins anew.
    """

    SCHEMA = "state string, exit_code int, exit_ms long"
    OUTPUT = "session_id string, state string, at timestamp"

    def __init__(self, grace_seconds: int = 300):
        self.grace = grace_seconds * 1000

    def handleInputRows(self, key, rows, timerValues):
        state, code, exit_ms = self._get("unknown", None, None)
        out = []
        for r in _ordered(rows):
            new = state
            if r["kind"] == "turn_lifecycle":
                new = {"turn_started": "active_turn", "turn_complete": "between_turns", "turn_failed": "between_turns", "input_requested": "waiting", "approval_requested": "waiting"}.get(r["phase"], state)
                if r["phase"] == "turn_started":
                    code = exit_ms = None
            elif r["kind"] == "process_lifecycle":
                code, exit_ms = r["exit_code"], _ms(r["event_ts"])
                if r["phase"] == "terminal_marker":
                    new = "terminal_completed"
                elif code:
                    new = "terminal_failed"
            if new != state:
                state = new
                out.append(Row(session_id=key[0], state=state, at=r["event_ts"]))
            last = _ms(r["event_ts"])
        pending = exit_ms is not None and not code and state not in ("terminal_completed", "terminal_failed")
        self._keep((state, code, exit_ms), exit_ms + self.grace if pending else last + FORGET_MS)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state, code, exit_ms = self._get("unknown", None, None)
        if exit_ms is not None and not code and state not in ("terminal_completed", "terminal_failed"):
            self._keep(("terminal_completed", code, exit_ms), exit_ms + FORGET_MS)
            yield Row(session_id=key[0], state="terminal_completed", at=_at(exit_ms + self.grace))
        else:
            self._forget()


class Stagnation(_Processor):
    """One row for each stretch without a marker that reaches the limit, unless a command runs (until its maximum).

    A stretch begins with a marker (or the session's first event), which is also its
    name: it is reported once, by the first later event or by the watermark, whichever
    comes first, and at the same time in both cases.  Within a session rows of one batch
    are taken in order; a marker that comes later than a newer one of another batch ends
    no stretch.  A session that has ended, or had no event for FORGET_MS, keeps no state;
    a new turn begins it again.
    """

    SCHEMA = "marker_ms long, open_ms long, reported_ms long, last_ms long"
    OUTPUT = "session_id string, last_progress timestamp, at timestamp"

    def __init__(self, seconds: int = 1500, max_command_seconds: int = 3600, markers: tuple = MARKERS):
        self.limit, self.longest, self.markers = seconds * 1000, max_command_seconds * 1000, markers

    def _deadline(self, marker: int, open_: int | None) -> int:
        return max(marker + self.limit, open_ + self.longest if open_ is not None else 0)

    def handleInputRows(self, key, rows, timerValues):
        marker, open_, reported, last = self._get(None, None, None, None)
        ended, out = False, []
        for r in _ordered(rows):
            at = _ms(r["event_ts"])
            last = at if last is None else max(at, last)
            if marker is not None and reported != marker and at >= (due := self._deadline(marker, open_)):
                reported = marker
                out.append(Row(session_id=key[0], last_progress=_at(marker), at=_at(due)))
            ended = ended if _ends(r) is None else _ends(r)
            if ended:
                marker = open_ = reported = None
                continue
            if marker is None or (r["kind"] in self.markers and at > marker):
                marker = at
            if r["kind"] == "command":
                open_ = at
            elif r["kind"] == "command_result":
                open_ = None
        if ended:
            self._forget()
        else:
            self._keep((marker, open_, reported, last), last + FORGET_MS if reported == marker else self._deadline(marker, open_))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        marker, open_, reported, last = self._get(None, None, None, None)
        if marker is None:
            return
        if reported != marker:
            self._keep((marker, open_, marker, last), max(last, self._deadline(marker, open_)) + FORGET_MS)
            yield Row(session_id=key[0], last_progress=_at(marker), at=_at(self._deadline(marker, open_)))
        else:
            self._forget()


class Repetition(StatefulProcessor):
    """A row when a command is run, or an error seen, for the n-th time in a row.

    Counts go when the session has ended or had no event for FORGET_MS.  A count is read
    and written once for the rows of a batch, and not read at all for a new session.
    """

    READS = (*READS, "command_norm", "error_fp")
    OUTPUT = "session_id string, kind string, subject string, n long, at timestamp"

    def __init__(self, n: int = 3):
        self.n = n

    def init(self, handle) -> None:
        self.handle = handle
        self.epoch = handle.getValueState("epoch", "epoch long, timer_ms long")
        self.counts = handle.getMapState("counts", "subject string", "n long, outcome int, epoch long")

    def handleInputRows(self, key, rows, timerValues):
        known = self.epoch.exists()
        epoch, timer = self.epoch.get() if known else (0, None)
        ended, last, counts = False, 0, {}
        for r in _ordered(rows):
            kind, last = r["kind"], _ms(r["event_ts"])
            ended = ended if _ends(r) is None else _ends(r)
            if kind == "file_changed":
                epoch += 1
            if kind == "command_result" and r["command_norm"] is not None:
                kind, subject, outcome, own = "repeated_command", r["command_norm"], r["exit_code"], epoch
            elif kind == "error" and r["error_fp"] is not None:
                kind, subject, outcome, own = "recurring_error", r["error_fp"], None, 0
            else:
                continue
            name = (f"{kind}/{subject}",)
            if name not in counts:
                counts[name] = self.counts.getValue(name) if known and self.counts.containsKey(name) else (0, outcome, own)
            n, was, when = counts[name]
            n = n + 1 if (was, when) == (outcome, own) else 1
            counts[name] = (n, outcome, own)
            if n == self.n:
                yield Row(session_id=key[0], kind=kind, subject=subject, n=n, at=r["event_ts"])
        due = None if ended else last + FORGET_MS
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if ended:
            if known:
                self._forget()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.epoch.update((epoch, due))
        for name, count in counts.items():
            self.counts.updateValue(name, count)

    def _forget(self) -> None:
        self.epoch.clear()
        self.counts.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._forget()
        return iter(())

    def close(self) -> None:
        pass


class Cadence(_Processor):
    """Assessment triggers, one for a session and micro-batch at most: a first event, a change, a marker, or the time.

    Nothing is triggered by time once a session has ended; a session without events
    for ``quiet`` cadences is left alone until its next event, and keeps no state once
    it had none for FORGET_MS.
    """

    SCHEMA = "assessed_ms long, event_ms long"
    OUTPUT = "session_id string, reason string, at timestamp"

    def __init__(self, seconds: int = 600, markers: tuple = MARKERS, quiet: int = 6):
        self.seconds, self.markers, self.quiet = seconds * 1000, markers, quiet

    def handleInputRows(self, key, rows, timerValues):
        last, newest = self._get(None, None)
        found, ended = None, False
        for r in _ordered(rows):
            ms = _ms(r["event_ts"])
            newest = ms if newest is None else max(ms, newest)
            ended = ended if _ends(r) is None else _ends(r)
            if last is None and (found is None or found[0] == "first"):
                found = found or ("first", ms)
            if r["kind"] in ("turn_lifecycle", "process_lifecycle") and last is not None:
                found = ("lifecycle", ms)
            elif r["kind"] in self.markers and last is not None and (found is None or found[0] != "lifecycle"):
                found = ("marker", ms)
            elif found is None and ms - last >= self.seconds:
                found = ("cadence", ms)
        assessed = found[1] if found else last
        if ended:
            self._forget()
        else:
            self._keep((assessed, newest), assessed + self.seconds)
        if found:
            yield Row(session_id=key[0], reason=found[0], at=_at(found[1]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, newest = self._get(None, None)
        if last is None:
            return
        ms = expiredTimerInfo.getExpiryTimeInMs()
        if ms > newest + self.quiet * self.seconds:  # beyond the last cadence only the end of the state has a timer
            self._forget()
            return
        more = ms + self.seconds <= newest + self.quiet * self.seconds
        self._keep((ms, newest), ms + self.seconds if more else newest + max(FORGET_MS, (self.quiet + 1) * self.seconds))
        yield Row(session_id=key[0], reason="cadence", at=_at(ms))


def apply(ev: DataFrame, processor, watermark: str = "1 hour") -> DataFrame:
    """The processor over a stream of events, by session."""
    ev.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    reads = [c for c in ev.columns if c in ("session_id", *processor.READS)]
    late = ev.select(*reads).withWatermark("event_ts", watermark)
    return late.groupBy("session_id").transformWithState(statefulProcessor=processor, outputStructType=processor.OUTPUT, outputMode="append", timeMode="eventTime")


def dedupe_stream(ev: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark; what comes later still meets the store's own check."""
    return ev.withWatermark("event_ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
