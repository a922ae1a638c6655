"""Sessions of turns that arrive in any order, against the batch operators."""

import random

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import chat
from tessera.streaming import chat_state, unordered_chat

TEXTS = ["hi", "mode precise", "ok", "switch", "x", "switch 2", "clear", "mode auto", "y", "mode nonsense", "switch", None, " ", "MODE creative", "z", "quit", "late", "later"]
COLUMNS = ["conv_id", "turn", "kind", "segment", "stage", "locked"]


def _batch(spark, rows):
    turns = spark.createDataFrame(rows, chat_state.TURN_SCHEMA).withColumn("text", F.coalesce("text", F.lit("")))
    out = chat.active_stage(chat.attach_modes(chat.segment_sessions(turns)))
    return {tuple(r) for r in out.select(*COLUMNS[:5], F.expr("nullif(locked, 'auto')").alias("locked")).collect()}


def _current(spark, folder):
    rows = [tuple(r) for r in unordered_chat.current_turns(spark.read.parquet(folder)).select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_any_arrival_equals_the_batch_operators(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 or c % 2 else "assistant", TEXTS[(t + c) % len(TEXTS)]) for c in range(6) for t in range(18)]
    rows += [(None, t, "user", TEXTS[t]) for t in range(8)] + [(9, t, "user", TEXTS[t]) for t in (1, 3, 5)]  # no id; gaps that stay
    mixed = random.Random(5).sample(rows, len(rows))
    for i in range(4):
        part = mixed[i::4] + mixed[:3] * (i > 0) + [(0, None, "user", "quit")]  # repeats, and rows without a number
        spark.createDataFrame(part, chat_state.TURN_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    provider = spark.conf.get(unordered_chat.PROVIDER, None)
    for _ in range(2):  # a second start finds nothing new
        unordered_chat.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.conf.get(unordered_chat.PROVIDER, None) == provider
    assert _current(spark, f"{tmp_path}/out") == _batch(spark, rows)
    # what waits is only what stands beyond a gap, and quit leaves a mark alone
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/check")
    assert {r[0] for r in state.select("key.conv_id").distinct().collect()} == {9}
    ended = spark.read.format("statestore").option("stateVarName", "settled").load(f"{tmp_path}/check").select("key.conv_id", "value.*")
    assert {r.conv_id for r in ended.filter("ended").collect()} == {c for c, t, role, text in rows if text == "quit" and role == "user"}


class _Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):
        return _Value()

    getListState = getValueState

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class _Now:
    def __init__(self, at):
        self.at = at

    def getCurrentProcessingTimeInMs(self):
        return self.at


def _effects(rows):
    kinds = {"q": "quit", "c": "clear", "m": "message"}
    return pd.DataFrame([(1, t, kinds[k], int(k == "c"), None, None, 0) for t, k in rows], columns=["conv_id", *unordered_chat.EFFECTS])


def test_versions_withdrawals_patience_and_quit():
    s = unordered_chat.Sessions(0, 50, None)
    handle = _Handle()
    s.init(handle)

    def send(at, rows):
        parts = list(s.handleInputRows((1,), iter([_effects(rows)]), _Now(at)))
        return [tuple(r) for p in parts for r in p[["turn", "segment", "version", "withdrawn"]].itertuples(index=False, name=None)]

    assert send(10, [(2, "m"), (3, "m")]) == [(2, 0, 10, False), (3, 0, 10, False)] and handle.timers == [60]
    assert send(20, [(3, "c")]) == []  # a number that comes again
    assert send(20, [(1, "c")]) == [(1, 1, 20, False), (2, 1, 20, False), (3, 1, 20, False)]
    assert len(s.open.get()) == 3 and handle.timers == [70]
    assert list(s.handleExpiredTimer((1,), _Now(70), None)) == []  # turn 0 is given up
    assert s.settled.get()[:5] == (1, unordered_chat.START_STAGE, None, 4, False) and not s.open.exists()
    assert send(80, [(0, "c")]) == []
    assert send(80, [(6, "m"), (7, "m")]) == [(6, 1, 80, False), (7, 1, 80, False)]
    assert send(80, [(5, "q")]) == [(6, 1, 81, True), (7, 1, 81, True)]
    assert send(90, [(4, "c")]) == [(4, 2, 90, False)]
    assert not s.open.exists() and s.settled.get()[4] and handle.timers == []
    assert send(95, [(6, "m")]) == []
