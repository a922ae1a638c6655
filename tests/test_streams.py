"""Q1 and Q2 against batch results, with steps that span files, corrections, late and repeated starts."""

from pyspark.sql import functions as F

from tessera.operators import chat
from tessera.operators.ranking import rank_layers
from tessera.streaming import chat_state, live_ranking
from tessera.streaming.state_table import StateTable


def test_ranking_merges_points_of_a_step_from_several_files(spark, tmp_path):
    rows = [(f"run{k}", k, float(step), (k * 7 + step) % 5 + k / 10, 2) for step in (100, 200, 7000) for k in range(6)]
    old = [(r, k, s, loss + 3, 1) for r, k, s, loss, _ in rows[::2]]
    schema = "run_name string, layer int, step double, loss double, seq long"
    for i in range(4):  # corrections come before and after what they correct
        spark.createDataFrame((rows[i::4] + old[(i + 1) % 4::4]) or rows[:1], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second start finds nothing new
        live_ranking.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", max_files_per_trigger=1).awaitTermination()
    got = sorted(tuple(r) for r in live_ranking.current_rankings(spark, f"{tmp_path}/out").select("step", "layer", "loss", "rank").collect())
    want = sorted(tuple(r) for r in rank_layers(spark.createDataFrame(rows, schema)).collect())
    assert got == want


def test_sessions_equal_the_batch_operators(spark, tmp_path):
    texts = ["hi", "mode precise", "ok", "switch", "x", "switch 2", "clear", "mode auto", "y", "mode nonsense", "switch", None, " ", "MODE creative", "z", "quit", "late", "later"]
    rows = [(c, t, "user" if t % 2 == 0 or c % 2 else "assistant", texts[(t + c) % len(texts)]) for c in range(6) for t in range(18)]
    for lo in (0, 5, 11):
        part = [r for r in rows if lo <= r[1] < {0: 5, 5: 11, 11: 18}[lo]]
        spark.createDataFrame(part, chat_state.TURN_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        chat_state.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    columns = ["conv_id", "turn", "kind", "segment", "stage", "locked"]
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*columns).collect()}
    turns = spark.createDataFrame(rows, chat_state.TURN_SCHEMA).withColumn("text", F.coalesce("text", F.lit("")))
    batch = chat.active_stage(chat.attach_modes(chat.segment_sessions(turns)))
    want = {tuple(r) for r in batch.select(*columns[:5], F.expr("nullif(locked, 'auto')").alias("locked")).collect()}
    assert got == want


def _files(folder):
    return sum(1 for p in folder.rglob("*.parquet"))


def test_state_table_stays_small_and_keeps_the_newest(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "k long, v string, seq long, block long", ["block", "k"], "block", "seq", fan=3, retain=2)
    want, most = {}, 0
    for epoch in range(20):
        rows = [(k, f"{epoch}-{k}", (epoch * 7 + k) % 5, k % 2) for k in range(epoch % 4, 12, 3)]
        assert table.merge(spark.createDataFrame(rows, table.schema), epoch)
        for k, v, seq, block in rows:
            if k not in want or seq >= want[k][1]:
                want[k] = (v, seq, block)
        most = max(most, _files(tmp_path / "t"))
        if epoch % 6 == 5:
            assert {r.k: (r.v, r.seq, r.block) for r in table.read().collect()} == want
    assert not table.merge(spark.createDataFrame(rows, table.schema), 19)  # again
    assert {r.k: (r.v, r.seq, r.block) for r in table.read().collect()} == want
    assert {r.k for r in table.read([1]).collect()} == {k for k in want if k % 2}
    state = table.manifests.latest()
    assert len(table.manifests.versions()) <= 2 and all(len(level) < 3 for level in state["levels"])
    assert most <= 2 * (3 * 3 + 2 * 3 + 3) and state["version"] == 20  # two blocks, three levels, what waits to be dropped


def test_only_changed_rankings_are_written_and_a_retry_changes_nothing(spark, tmp_path):
    schema = live_ranking.POINT_SCHEMA
    rows = [(f"r{k}", k, float(step), float((k * 3 + step) % 4), 1) for step in (10, 20, 6000) for k in range(4)]
    batches = [rows, rows[:2], [("r9", 9, 20.0, -1.0, 1)], [("r9", 9, 20.0, float("nan"), 2)]]
    for epoch, part in enumerate(batches):
        live_ranking.update(spark.createDataFrame(part, schema), epoch, str(tmp_path / "o"))
    counts = [spark.read.parquet(f"{tmp_path}/o/changes/epoch={e}").count() for e in range(4)]
    assert counts == [12, 0, 5, 5]  # a repeated point changes no rank; a new best one moves all of its step
    before, files = sorted(map(str, live_ranking.current_rankings(spark, str(tmp_path / "o")).collect())), _files(tmp_path / "o")
    live_ranking.update(spark.createDataFrame(batches[3], schema), 3, str(tmp_path / "o"))
    assert sorted(map(str, live_ranking.current_rankings(spark, str(tmp_path / "o")).collect())) == before and _files(tmp_path / "o") == files
    last = {(r, l, s): (x, q) for part in batches for r, l, s, x, q in part}
    want = rank_layers(spark.createDataFrame([(*k, *v) for k, v in last.items()], schema))
    assert before == sorted(map(str, want.collect()))


def test_a_session_of_few_turns_takes_a_loop_not_column_operations(monkeypatch):
    import pandas as pd

    class State:
        exists = hasTimedOut = False

        def update(self, value):
            self.kept = value

    def refused(*args):
        raise AssertionError("column operations for each conversation")

    monkeypatch.setattr(chat_state, "_continued", refused)
    nan = float("nan")
    rows = pd.DataFrame({"conv_id": 5, "turn": [3, 0, 2, 1, 4], "kind": ["quit", "switch", "mode", "switch", "late"], "breaks": [0, 1, 0, 1, 0],
                         "sets": [None, None, "precise", None, None], "jumps": [nan, 2.0, nan, nan, nan], "cycles": [0, 0, 0, 1, 0]})
    state = State()
    out, = chat_state._session((5,), iter([rows.iloc[:2], rows.iloc[2:]]), state, None)
    assert out[["turn", "segment", "stage"]].values.tolist() == [[0, 1, 2], [1, 2, 3], [2, 2, 3]] and out["locked"].isna().all()
    assert state.kept == (None, None, None, True)
