"""Sessions of turns in any order by rows: few calls for state, no frame for each conversation, the same answers."""

import random

import pandas as pd
from pyspark.sql import Row

from tessera.operators.chat import START_STAGE
from tessera.streaming import chat_state, unordered_chat

IN_ROW = Row("conv_id", *unordered_chat.EFFECTS)
EFFECTS = {"hi": ("message", 0, None, None, 0), "clear": ("clear", 1, None, None, 0), "switch": ("switch", 1, None, None, 1),
           "switch 2": ("switch", 1, None, 2.0, 0), "mode precise": ("mode", 0, "precise", None, 0), "mode auto": ("mode", 0, "auto", None, 0),
           "mode": ("mode", 0, None, None, 0), "quit": ("quit", 0, None, None, 0)}


class _State:
    def __init__(self, calls, name):
        self.calls, self.name, self.value = calls, name, None

    def exists(self):
        self.calls.append(f"{self.name}.exists")
        return self.value is not None

    def get(self):
        self.calls.append(f"{self.name}.get")
        return self.value

    def update(self, value):
        self.calls.append(f"{self.name}.put")
        self.value = value

    put = update

    def clear(self):
        self.calls.append(f"{self.name}.clear")
        self.value = None


class _Handle:
    def __init__(self):
        self.calls = []

    def getValueState(self, name, *_):
        return _State(self.calls, name)

    getListState = getValueState


class _Now:
    def getCurrentProcessingTimeInMs(self):
        return -1


def _sessions(forget_ms=None):
    s, handle = unordered_chat.RowSessions(0, None, forget_ms), _Handle()
    s.init(handle)
    return s, handle.calls


def _send(s, turns, key=7):
    rows = (IN_ROW(key, turn, *EFFECTS[text]) for turn, text in turns)
    return [r.asDict() for r in s.handleInputRows((key,), rows, _Now())]


def test_a_batch_takes_few_calls_and_no_frame(monkeypatch):
    def refused(*args, **kwargs):
        raise AssertionError("a frame for each conversation")

    monkeypatch.setattr(pd, "DataFrame", refused)
    monkeypatch.setattr(pd, "concat", refused)
    s, calls = _sessions()

    def took():
        out = list(calls)
        calls.clear()
        return out

    assert [r["segment"] for r in _send(s, [(1, "clear"), (0, "hi")])] == [0, 1] and took() == ["settled.get", "settled.put"]
    assert len(_send(s, [(3, "hi")])) == 1 and took() == ["settled.get", "waiting.get", "settled.put", "waiting.put"]
    assert _send(s, [(3, "clear"), (0, "clear")]) == [] and took() == ["settled.get", "waiting.get"]  # numbers that come again
    assert len(_send(s, [(2, "quit")])) == 1 and took() == ["settled.get", "waiting.get", "settled.put", "waiting.clear"]
    assert _send(s, [(4, "hi")]) == [] and took() == ["settled.get"]  # after quit
    s, calls = _sessions(forget_ms=50)  # a TTL is put off by every turn
    _send(s, [(0, "quit")])
    calls.clear()
    assert _send(s, [(4, "hi")]) == [] and took() == ["settled.get", "settled.put"]


def test_any_arrival_equals_column_operations():
    for seed in range(60):
        rng = random.Random(seed)
        names = [n for n in EFFECTS if n != "quit"] * 4 + ["quit"] * (seed % 3)
        texts = [rng.choice(names) for _ in range(rng.randrange(1, 40))]
        arrivals = rng.sample(list(enumerate(texts)), len(texts))
        s, _ = _sessions()
        newest, versions, at = {}, {}, 0
        while at < len(arrivals):
            n = rng.randrange(1, 9)
            batch = arrivals[at:at + n] + arrivals[:at][:rng.randrange(3)]
            at += n
            for r in _send(s, batch):
                assert r["version"] > versions.get(r["turn"], 0) and r["conv_id"] == 7
                versions[r["turn"]], newest[r["turn"]] = r["version"], r
            have = dict(arrivals[:at])
            rows = pd.DataFrame([(t, *EFFECTS[have[t]]) for t in sorted(have)], columns=unordered_chat.EFFECTS)
            rows = rows.astype({"jumps": "float64"})
            want = chat_state._continued(rows, 0, START_STAGE, None)
            end = next((t for t in sorted(have) if have[t] == "quit"), len(texts))
            want = {r.turn: (r.kind, r.segment, r.stage, r.locked if r.locked != "auto" and isinstance(r.locked, str) else None)
                    for r in want.itertuples() if r.turn < end}
            assert {t: (r["kind"], r["segment"], r["stage"], r["locked"]) for t, r in newest.items() if not r["withdrawn"]} == want


def test_the_least_of_a_repeated_number_counts_wherever_it_stands_in_a_batch():
    turns = [(t, "switch" if t == 1 else "hi") for t in range(25_000)]
    s, _ = _sessions()
    told = _send(s, [*turns, (1, "clear"), (1, "quit")])
    assert len(told) == 25_000 and {r["segment"] for r in told[1:]} == {1} and told[1]["kind"] == "clear"
    assert {r["stage"] for r in told} == {START_STAGE} and s.settled.value[3] == 25_000 and s.open.value is None


def test_ids_beyond_doubles_stay_exact_beside_none(spark, tmp_path):
    rows = [(c, t, "user", "hi") for c in (2**60 + 1, 2**60 + 2, None) for t in range(3)]
    spark.createDataFrame(rows, chat_state.TURN_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # all in one task
    try:
        unordered_chat.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    out = unordered_chat.current_turns(spark.read.parquet(f"{tmp_path}/out")).select("conv_id", "turn").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(str(r[:2]) for r in rows)


def test_only_texts_of_commands_are_split(spark):
    rows = [(1, t, "user", x) for t, x in enumerate(["hi there", "mode precise", "switch 2", "switch", "models are", "clear", None, "mode auto"])]
    effects = chat_state.turn_effects(spark.createDataFrame(rows, chat_state.TURN_SCHEMA).repartition(1))
    plan = effects._jdf.queryExecution().optimizedPlan().toString()
    assert "split(trim(_command" in plan and "split(trim(text" not in plan
    got = [tuple(r) for r in effects.orderBy("turn").select(*unordered_chat.EFFECTS[1:]).collect()]
    assert got == [EFFECTS[n] for n in ("hi", "mode precise", "switch 2", "switch", "mode", "clear")] + [("blank", 0, None, None, 0), EFFECTS["mode auto"]]
