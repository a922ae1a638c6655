"""Q2: live chat session state per conversation.

What a turn does (its kind, whether it opens a segment, the mode it sets, the stage it names) are
columns made by the batch operators (H6, H8, H9) before the turns are grouped. The state of a
conversation is what those columns add up to so far: segment, stage, lock, and whether it has ended.
Turns of one conversation must arrive in turn order across batches, as a live chat's do.

After ``quit`` only a mark stays, so that late turns are ignored. A query that runs on drops it after
``forget_after``, and so the state of a conversation that nobody has continued for that long. A query that
ends when its input does (``availableNow``) has no clock to wait for and keeps the marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.chat import NUM_STAGES, START_STAGE, mode_value, stage_jump, turn_kind

TURN_SCHEMA = "conv_id long, turn long, role string, text string"
OUT_SCHEMA = "conv_id long, turn long, kind string, segment long, stage int, locked string"
STATE_SCHEMA = "segment long, stage int, locked string, ended boolean"
FORGET_AFTER = "24 hours"


def turn_effects(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, kind, breaks, sets, jumps, cycles): what each turn does to the session."""
    t = turns.withColumn("kind", turn_kind(F.col("role"), F.col("text")))
    # shared parts of the expressions below are computed for every row, so only texts of these commands are there to be split
    t = t.withColumn("_command", F.when(F.col("kind").isin("mode", "switch"), F.col("text")))
    jump = stage_jump(F.col("kind"), F.col("_command"))
    return t.select("conv_id", "turn", "kind", F.col("kind").isin("clear", "switch").cast("int").alias("breaks"),
                    mode_value(F.col("kind"), F.col("_command")).alias("sets"), jump.cast("double").alias("jumps"),
                    ((F.col("kind") == "switch") & jump.isNull()).cast("int").alias("cycles"))


def _continued(rows: pd.DataFrame, segment: int, stage: int, locked: str | None) -> pd.DataFrame:
    """The session at each of the turns, given where it stood before them (columns as turn_effects makes them).

    For tests: the column form of what the loops over a conversation's turns compute."""
    jumps = rows["jumps"]
    since = rows["cycles"].groupby(jumps.notna().cumsum()).cumsum()
    before = rows["sets"].shift(1)
    before.iloc[0] = locked
    return rows.assign(
        segment=segment + rows["breaks"].cumsum(),
        stage=((jumps.ffill().fillna(stage) - 1 + since) % NUM_STAGES + 1).astype("int32"),
        locked=before.ffill(),
    )


def _session(key, parts: Iterator[pd.DataFrame], state, forget_ms: int | None) -> Iterator[pd.DataFrame]:
    columns = ["conv_id", "turn", "kind", "segment", "stage", "locked"]
    if state.hasTimedOut:
        state.remove()
        return
    segment, stage, locked, ended = state.get if state.exists else (0, START_STAGE, None, False)
    parts = list(parts)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts)
    order = np.argsort(rows["turn"].to_numpy(), kind="stable")
    kinds, breaks, sets, jumps, cycles = (rows[c].to_numpy()[order].tolist() for c in ("kind", "breaks", "sets", "jumps", "cycles"))
    n = kinds.index("quit") if "quit" in kinds else len(kinds)
    if not ended and n:
        # a chat has few turns a batch, for which a loop costs a tenth of column operations
        segments, stages, locks = [], [], []
        for opens, mode, jump, cycle in zip(breaks[:n], sets, jumps, cycles):
            segment += opens
            stage = (int(stage if jump is None or jump != jump else jump) - 1 + cycle) % NUM_STAGES + 1
            segments.append(segment)
            stages.append(stage)
            locks.append(None if locked == "auto" else locked)
            locked = mode if isinstance(mode, str) else locked
        first = order[:n]
        yield pd.DataFrame({"conv_id": rows["conv_id"].to_numpy()[first], "turn": rows["turn"].to_numpy()[first], "kind": kinds[:n], "segment": segments,
                            "stage": np.array(stages, np.int32), "locked": pd.Series(locks, dtype=object)}, columns=columns)
    ended = ended or n < len(kinds)
    state.update((None, None, None, True) if ended else (segment, stage, locked, False))
    if forget_ms is not None:
        state.setTimeoutDuration(forget_ms)


def session_states(turns: DataFrame, forget_after: str | None = FORGET_AFTER) -> DataFrame:
    """Streaming turns -> per-turn session state; ``forget_after`` None: keep every conversation's state."""
    forget_ms = None if forget_after is None else int(pd.Timedelta(forget_after).total_seconds() * 1000)

    def advance(key, parts, state):
        return _session(key, parts, state, forget_ms)

    timeout = GroupStateTimeout.NoTimeout if forget_after is None else GroupStateTimeout.ProcessingTimeTimeout
    return turn_effects(turns).groupBy("conv_id").applyInPandasWithState(advance, OUT_SCHEMA, STATE_SCHEMA, "append", timeout)


def start(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, max_files_per_trigger: int = 1,
          every: str | None = None, forget_after: str = FORGET_AFTER):
    """Process what is there and end, or with ``every`` (a trigger interval) run on and forget."""
    stream = (spark.readStream.schema(TURN_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    out = session_states(stream, forget_after if every else None)
    writer = (out.writeStream.format("parquet").option("path", out_dir)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
