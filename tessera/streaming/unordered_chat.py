"""Q2 for turns that arrive out of order: session state per conversation with ``transformWithState``.

A conversation's turns are numbered without gaps from ``first_turn``. What stands before the first gap is settled: only the
session after it is kept (one value). Turns beyond a gap wait in a list with what was last said of them. Every turn is
answered at once from what has arrived; where a late turn changes an answer, the answer is given again under a higher
``version``, and ``withdrawn`` takes back answers to turns that turn out to follow ``quit``. So the newest version of each turn
(``current_turns``) equals the batch operators (H6, H8, H9) on all turns that have arrived, in whatever order they came.

Defined cases: a turn number that comes again is ignored (within one batch, the least of kind and effects counts); so are
turns after ``quit`` and rows without a turn number, which have no place in a session; rows without ``conv_id`` are one conversation.
``patience`` (off by default) settles a gap that stays open so long, and turns that come to it later are ignored. ``forget_after`` is
the TTL of all state of a conversation that nobody continues; ``quit`` drops the waiting turns at once and leaves only a mark.

Spark hands state to Python workers through a listener in each task: a loopback port, or a socket file with
``spark.python.unix.domain.socket.enabled``, which sessions of ``tessera.session`` set.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.chat import NUM_STAGES, START_STAGE
from .chat_state import FORGET_AFTER, TURN_SCHEMA, turn_effects

OUT_SCHEMA = "conv_id long, turn long, kind string, segment long, stage int, locked string, version long, withdrawn boolean"
SETTLED_SCHEMA = "segment long, stage int, locked string, next_turn long, ended boolean, version long"
WAITING_SCHEMA = ("turn long, kind string, breaks int, sets string, jumps double, cycles int, "
                  "shown boolean, shown_segment long, shown_stage int, shown_locked string")
ANSWER = ["segment", "stage", "locked"]
EFFECTS = ["turn", "kind", "breaks", "sets", "jumps", "cycles"]
TOLD = ["turn", "kind", *ANSWER, "version", "withdrawn"]
TOLD_ROW = Row("conv_id", *TOLD)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _effects(turn, kind, breaks, sets, jumps, cycles) -> tuple:
    """A turn's effects as plain values, whatever a frame holds them as."""
    return (int(turn), kind, int(breaks), sets if isinstance(sets, str) else None,
            None if jumps is None or jumps != jumps else float(jumps), int(cycles))


def _rank(effects: tuple) -> tuple:
    """Order of two turns with the same number; what is missing comes last."""
    turn, kind, breaks, sets, jumps, cycles = effects
    return turn, kind, breaks, sets is None, sets or "", jumps is None, jumps or 0, cycles


def _followed(rows: list[tuple], segment: int, stage: int, locked: str | None) -> Iterator[tuple]:
    """(row, segment, stage, lock before it, lock after it) of each waiting row, given where the session stood before them."""
    for row in rows:
        segment += row[2]
        stage = (int(stage if row[4] is None else row[4]) - 1 + row[5]) % NUM_STAGES + 1
        before, locked = locked, row[3] or locked
        yield row, segment, stage, before, locked


class Sessions(StatefulProcessor):
    """State of one conversation: a value for the settled part, a list of the turns that wait beyond a gap."""

    def __init__(self, first_turn: int, patience_ms: int | None, forget_ms: int | None):
        self.first_turn, self.patience_ms, self.forget_ms = first_turn, patience_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", SETTLED_SCHEMA, self.forget_ms)
        self.open = handle.getListState("waiting", WAITING_SCHEMA, self.forget_ms)

    def _load(self) -> tuple[list, list]:
        """Nothing waits where no value was written, nor after ``quit``: most conversations take one call."""
        value = self.settled.get()
        if value is None:
            return [0, START_STAGE, None, self.first_turn, False, 0], []
        return list(value), [] if value[4] else [tuple(r) for r in self.open.get() or ()]

    def _store(self, session: list, waiting: list, had: bool, changed: bool, now: int) -> None:
        """What has not changed is written only where that puts off its TTL."""
        write = changed or self.forget_ms is not None
        if write:
            self.settled.update(tuple(session))
        for at in list(self.handle.listTimers()) if self.patience_ms is not None else []:
            self.handle.deleteTimer(at)
        if waiting and write:
            self.open.put(waiting)
        elif had and not waiting:
            self.open.clear()
        if waiting and self.patience_ms is not None:
            self.handle.registerTimer(now + self.patience_ms)

    def _arrive(self, session: list, waiting: list, fresh: list, now: int) -> tuple[list, list, list]:
        """The session, what waits, and the answers that are new or have changed."""
        version, settled, ended, visible = max(session[5] + 1, now), session[:4], False, True
        waits, out = [], []
        rows = sorted([*waiting, *((*r, False, None, None, None) for r in fresh)], key=itemgetter(0))
        # a conversation has few turns, for which a loop costs a small part of column operations
        for row, segment, stage, before, after in _followed(rows, *session[:3]):
            turn, kind, shown = row[0], row[1], row[6]
            answer = (segment, stage, None if before == "auto" else before)
            visible = visible and kind != "quit"
            if shown != visible or (visible and answer != row[7:]):
                out.append((turn, kind, *answer, version, not visible))
            if turn == settled[3]:
                settled, ended = [segment, stage, after, turn + 1], ended or kind == "quit"
            else:
                waits.append((*row[:6], visible, *answer))
        if ended:
            return [None, None, None, None, True, version], [], out
        return [*settled, False, version], waits, out

    def _advance(self, rows: Iterator[tuple], now: int) -> list[tuple]:
        """Takes a batch's turns of a conversation (``EFFECTS``) to the state; (turn, kind, answer, version, withdrawn) to be told."""
        session, waiting = self._load()
        had, out, fresh = bool(waiting), [], {}
        if not session[4]:
            known = {r[0] for r in waiting}
            for r in rows:
                if r[0] >= session[3] and r[0] not in known and (r[0] not in fresh or _rank(r) < _rank(fresh[r[0]])):
                    fresh[r[0]] = r
        if fresh:
            session, waiting, out = self._arrive(session, waiting, list(fresh.values()), now)
        self._store(session, waiting, had, bool(fresh), now)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """By frames (``transformWithStateInPandas``); queries use ``RowSessions``."""
        turns = (_effects(*r) for part in rows for r in part[EFFECTS].itertuples(index=False, name=None))
        out = self._advance(turns, timerValues.getCurrentProcessingTimeInMs())
        if out:
            told = pd.DataFrame(out, columns=TOLD)
            told.insert(0, "conv_id", pd.array([key[0]] * len(out), dtype="Int64"))
            yield told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        session, waiting = self._load()
        if waiting:
            rows = sorted(waiting, key=itemgetter(0))
            for row, segment, stage, _, after in _followed(rows, *session[:3]):
                settled = [segment, stage, after, row[0] + 1, False]
            ended = any(row[1] == "quit" for row in rows)
            self.settled.update((*([None, None, None, None, True] if ended else settled), session[5]))
            self.open.clear()
        return iter([])

    def close(self) -> None:
        pass


class RowSessions(Sessions):
    """The same by rows (``transformWithState``), without a frame for each conversation: ``conv_id`` and ``EFFECTS`` in, ``OUT_SCHEMA`` out."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for told in self._advance((r[1:] for r in rows), timerValues.getCurrentProcessingTimeInMs()):
            yield TOLD_ROW(key[0], *told)


def _ms(span: str | None) -> int | None:
    return None if span is None else int(pd.Timedelta(span).total_seconds() * 1000)


def session_states(turns: DataFrame, first_turn: int = 0, patience: str | None = None, forget_after: str | None = None) -> DataFrame:
    """Streaming turns in any order -> versions of each turn's answer (``OUT_SCHEMA``).

    With ``patience`` or ``forget_after`` the query has a clock to wait for, so it must run on; one that ends
    with its input (``availableNow``) takes neither.
    """
    placed = turn_effects(turns.filter(F.col("turn").isNotNull())).select("conv_id", *EFFECTS)
    clock = "none" if patience is None and forget_after is None else "processingTime"
    return placed.groupBy("conv_id").transformWithState(
        RowSessions(first_turn, _ms(patience), _ms(forget_after)), OUT_SCHEMA, "append", clock)


def current_turns(versions: DataFrame) -> DataFrame:
    """(conv_id, turn, kind, segment, stage, locked): the newest answer to each turn that is not taken back."""
    newest = versions.groupBy("conv_id", "turn").agg(F.max_by(F.struct("kind", *ANSWER, "withdrawn"), "version").alias("a"))
    return newest.filter("NOT a.withdrawn").select("conv_id", "turn", "a.kind", *(f"a.{c}" for c in ANSWER))


def start(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, max_files_per_trigger: int = 1,
          every: str | None = None, first_turn: int = 0, patience: str | None = None, forget_after: str = FORGET_AFTER):
    """Process what is there and end, or with ``every`` (a trigger interval) run on and forget.

    This kind of state needs Spark's RocksDB provider; a query keeps the setting it is started with, so the session's own is put back.
    """
    stream = (spark.readStream.schema(TURN_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
    out = session_states(stream, first_turn, patience if every else None, forget_after if every else None)
    writer = (out.writeStream.format("parquet").option("path", out_dir)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
